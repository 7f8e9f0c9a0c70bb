"""Shuffling, interleaving, sharding and sampling, all in an order that anyone can compute again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import bucket_bits, md5_rank, running_sum_by


def shuffled(df: DataFrame, key: Column, ties: list[str], seed: str = "42", bits: int | None = None) -> DataFrame:
    """Adds ``place`` from 1: the position of a row in the order of the md5 of seed and key.

    Ranks are distributed over buckets of bounded size: ``bits`` of the hash, by the number of rows unless given.
    """
    if bits is None:
        bits = bucket_bits(df.count())
    return md5_rank(df, [], F.concat_ws("|", F.lit(seed), key), ties, "place", bits)


def shards(df: DataFrame, place: str, size: int) -> DataFrame:
    """Adds ``shard``: rows by position into shards of ``size`` rows; the last may be smaller, none is empty."""
    return df.withColumn("shard", F.floor((F.col(place) - 1) / size))


def hash_split(key: Column, share: float, seed: str = "42") -> Column:
    """True for about ``share`` of the rows, by md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key)), 1, 8), 16, 10).cast("bigint") < int(share * 2**32)


def interleaved(df: DataFrame, file: str, order: str, turn: int = 1000, width: int = 100_000) -> DataFrame:
    """Adds ``turn, line``: reading every file in turns of ``turn`` lines, line from 1 in the file; order by turn, file, line."""
    own = running_sum_by(df, [file], F.floor(F.col(order) / width), [F.col(order)], F.lit(1), "line")
    return own.withColumn("turn", F.floor((F.col("line") - 1) / turn))


def budget_sample(df: DataFrame, group: list[str], order: str, size: Column, quota: Column, width: int = 100_000) -> DataFrame:
    """Rows of a group, in the order of a whole-number column, while their running size stays within the quota (the budget is the feature).

    Adds ``used``, the running size; it is distributed over ranges of ``width`` of the order.
    """
    return running_sum_by(df, group, F.floor(F.col(order) / width), [F.col(order)], size, "used").filter(F.col("used") <= quota)


def union_text(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``origin, text`` of several tables' text columns."""
    out = None
    for name, df, text in parts:
        one = df.select(F.lit(name).alias("origin"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out
