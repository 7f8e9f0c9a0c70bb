"""Ranks and running sums over groups of any size, without a task that holds a whole group.

Rows fall into buckets whose order is known beforehand: ranges of an ordered column, or the top bits
of a uniform hash, which make buckets of nearly equal size.  Bucket totals make a small table; their
running sum is the offset that each bucket adds to the running sum inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a group should hold.
BUCKET_ROWS = 250_000
MAX_BITS = 20
#: Bits of the md5 key that `md5_key` gives.
MD5_BITS = 60


def bucket_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Bits of the hash that cut a group of ``rows`` rows into buckets of about ``bucket_rows``."""
    return min(MAX_BITS, max(0, (max(1, rows) // bucket_rows).bit_length()))


def md5_key(text: Column) -> Column:
    """The first 60 bits of the md5 of a text, in the order of its hexadecimal digits."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def running_sum_by(df: DataFrame, group: list[str], bucket: Column | None, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows up to and including this one in its group.

    ``bucket`` must not decrease along ``order``; None makes each group one bucket.  Neither ``group``
    nor ``value`` may be null.  An empty input gives an empty result.  Of rows equal in ``order`` the
    order is open, the sums are whole.  Columns named ``_q_*`` are reserved.
    """
    keyed = df.withColumn("_q_v", value).withColumn("_q_b", F.lit(0).cast("long") if bucket is None else bucket)
    inside = keyed.withColumn(
        "_q_c", F.sum("_q_v").over(Window.partitionBy(*group, "_q_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    )
    if bucket is None:
        return inside.withColumn(out, F.col("_q_c")).drop("_q_v", "_q_b", "_q_c")
    totals = keyed.groupBy(*group, "_q_b").agg(F.sum("_q_v").alias("_q_t"))
    earlier = Window.partitionBy(*group).orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_q_o", F.coalesce(F.sum("_q_t").over(earlier), F.lit(0)))
    before = before.select(*[F.col(g).alias(f"_q_g{i}") for i, g in enumerate(group)], F.col("_q_b").alias("_q_b2"), "_q_o")
    on = F.col("_q_b") == F.col("_q_b2")
    for i, g in enumerate(group):
        on = on & (F.col(g) == F.col(f"_q_g{i}"))
    return (
        inside.join(before, on)
        .withColumn(out, F.col("_q_c") + F.col("_q_o"))
        .drop("_q_v", "_q_b", "_q_c", "_q_b2", "_q_o", *[f"_q_g{i}" for i in range(len(group))])
    )


def running_sum(df: DataFrame, group: list[str], ties: list[str], value: Column, out: str, bits: int, seed: int = 42) -> DataFrame:
    """``running_sum_by`` in the order of a hash of ``ties``, which should name a row uniquely."""
    keyed = df.withColumn("_q_h", F.xxhash64(F.lit(seed), *ties))
    # The sign bit leads: the bucket of a hash is the top bits of its unsigned value.
    bucket = F.shiftrightunsigned("_q_h", 64 - bits) if bits else None
    return running_sum_by(keyed, group, bucket, [F.col("_q_h"), *[F.col(t) for t in ties]], value, out).drop("_q_h")


def md5_rank(df: DataFrame, group: list[str], text: Column, ties: list[str], out: str, bits: int) -> DataFrame:
    """Adds ``out``: the rank from 1 in the order of the md5 of a text, within ``group`` (may be empty)."""
    keyed = df.withColumn("_q_h", md5_key(text)).withColumn("_q_all", F.lit(0))
    bucket = F.shiftright("_q_h", MD5_BITS - bits) if bits else None
    order = [F.col("_q_h"), *[F.col(t) for t in ties]]
    return running_sum_by(keyed, group or ["_q_all"], bucket, order, F.lit(1), out).drop("_q_h", "_q_all")
