"""The stateless stages on streams, and exact deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.articles import judged


def cleaned_stream(articles: DataFrame, **rules) -> DataFrame:
    """``cvid, reason, clean`` of a stream of articles; the same columns as on a table."""
    return judged(articles, **rules).select("cvid", "reason", "clean")


def first_seen(rows: DataFrame, time: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Drops rows whose key came before within the watermark; ``time`` is cast to TIMESTAMP, null keys are one key."""
    own = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return own.dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, key: str, value: str, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """``start, key, n, total`` in tumbling windows of event time."""
    own = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    out = own.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def drain(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a folder (with its own checkpoint) and reads that.

    In the mode ``complete`` every batch replaces the folder, so that the last one's result stays.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "complete":
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")).start()
    else:
        q = writer.format("parquet").option("path", f"{path}/rows").start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
