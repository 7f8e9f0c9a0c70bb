"""Rule waterfalls: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failing(rules: list[tuple[str, Column]], passed: str = "passed") -> Column:
    """Name of the first rule whose condition holds; a condition that is null doesn't hold."""
    reason = None
    for name, fails in rules:
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    return F.lit(passed) if reason is None else reason.otherwise(passed)


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """``reason, n, pct``: rows and percent of all rows; the window runs over one row a reason."""
    return df.groupBy(reason).agg(F.count("*").alias("n")).withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def confusion(df: DataFrame, kept: Column, good: Column) -> DataFrame:
    """One row: ``rows, filter_rate, precision, recall, f1, false_kill`` of a filter against labels (nulls are left out)."""
    one = df.select(kept.alias("k"), good.alias("g")).filter("k is not null and g is not null")

    def n(c: str) -> Column:
        return F.sum(F.expr(c).cast("long"))

    sums = one.agg(F.count("*").alias("rows"), n("k and g").alias("tp"), n("k and not g").alias("fp"), n("not k and g").alias("fn"))
    p, r = F.expr("tp / nullif(tp + fp, 0)"), F.expr("tp / nullif(tp + fn, 0)")
    return sums.select(
        "rows",
        F.round(F.expr("1 - (tp + fp) / nullif(rows, 0)"), 6).alias("filter_rate"),
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(F.expr("2D * tp / nullif(2 * tp + fp + fn, 0)"), 6).alias("f1"),
        F.round(F.expr("fn / nullif(tp + fn, 0)"), 6).alias("false_kill"),
    )
