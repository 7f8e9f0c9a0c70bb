"""Joins by position, by range, and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import running_sum_by

#: Rows of one key from which on its partner is broadcast instead of shuffled to.
HOT_ROWS = 1_000_000


def zip_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str, width: int = 100_000) -> DataFrame:
    """Row i of one table with row i of the other, in the order of a whole-number column; the longer one's rest is left out.

    Positions are distributed running counts over ranges of ``width`` of the order column, so no
    task sees a whole table.  Rows with a null order are left out.
    """

    def numbered(df: DataFrame, order: str) -> DataFrame:
        own = df.filter(F.col(order).isNotNull()).withColumn("_g", F.lit(0))
        return running_sum_by(own, ["_g"], F.floor(F.col(order) / width), [F.col(order)], F.lit(1), "_pos").drop("_g")

    return numbered(left, left_order).join(numbered(right, right_order), "_pos").withColumnRenamed("_pos", "pos")


def range_bucket(value: Column, ranges: list[tuple[int, int, str]]) -> Column:
    """Name of the range [lo, hi] that holds the value; null outside all of them."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(ranges):
        out = F.when(value.between(lo, hi), name).otherwise(out)
    return out


def range_join(df: DataFrame, value: str, ranges: DataFrame, width: int) -> DataFrame:
    """Rows with the ranges (lo, hi, name) that hold their value, for many ranges: an equi-join on cells of ``width``."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return df.withColumn("_cell", F.floor(F.col(value) / width)).join(cells, "_cell").filter(F.col(value).between(F.col("lo"), F.col("hi"))).drop("_cell")


def keyset_page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows with a key above ``after``, in its order (a page is the feature)."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def skew_join(left: DataFrame, right: DataFrame, on: str, weight: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join with ``right``, which has one row a key and in ``weight`` the number of rows that ``left`` has of it.

    Keys with more than ``hot`` rows stay where they are and meet their partner by a broadcast of at most
    (rows of left / hot) rows; the others are joined as Spark sees fit.  ``right`` should be a written table.
    ``weight`` isn't in the result.
    """
    heavy = right.filter(F.col(weight) > hot).drop(weight)
    light = right.filter(F.col(weight) <= hot).drop(weight)
    if not heavy.limit(1).count():
        return left.join(light, on)
    rest = left.join(F.broadcast(heavy.select(on)), on, "left_anti")
    return left.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))
