"""Writers: JSON lines, one folder a key, shards of fixed size, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode(mode).json(path)


def write_by_key(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """JSON lines in one folder a value of ``key``; input files of the same key add up."""
    df.write.mode(mode).partitionBy(key).json(path)


def write_shards(df: DataFrame, path: str, shard: str, order: str, mode: str = "error") -> None:
    """One folder a shard, rows in order inside; a shard is one file."""
    df.repartition(F.col(shard)).sortWithinPartitions(shard, order).write.mode(mode).partitionBy(shard).json(path)


def write_index(entries: DataFrame, pairs: DataFrame, path: str, mode: str = "error") -> dict[str, int]:
    """Entries and pairs as two tables; gives their row counts."""
    entries.write.mode(mode).parquet(f"{path}/entries")
    pairs.write.mode(mode).parquet(f"{path}/pairs")
    spark = entries.sparkSession
    return {name: spark.read.parquet(f"{path}/{name}").count() for name in ("entries", "pairs")}


def json_length(df: DataFrame) -> Column:
    """Length of a row as compact JSON."""
    return F.length(F.to_json(F.struct(*df.columns)))


def write_texts(df: DataFrame, path: str, name: str, text: str, mode: str = "error") -> None:
    """One folder of text a value of ``name``, each text with a line end behind it, null texts as empty ones."""
    df.select(F.col(name), F.coalesce(F.col(text), F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\n").partitionBy(name).text(path)


def write_neighbours(pairs: DataFrame, path: str, mode: str = "error") -> None:
    """Pairs (src, dst, sim) as adjacency lists, one JSON line a document with partners: ``key, near ARRAY<STRUCT<other, sim>>``, nearest first."""
    both = pairs.select("src", "dst", "sim").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    lists = both.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("dst").alias("other")))).alias("near"))
    near = F.transform("near", lambda x: F.struct(x["other"].alias("other"), (-x["far"]).alias("sim")))
    lists.select("key", near.alias("near")).write.mode(mode).json(path)


def parquet_to_jsonl(spark: SparkSession, source: str, path: str, mode: str = "error") -> None:
    """All rows of the Parquet files below a folder as JSON lines."""
    write_jsonl(spark.read.option("recursiveFileLookup", "true").parquet(source), path, mode)
