"""Event-time windows over a stream or a table of events, and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Count and sum per window and key; on a stream, rows later than ``late`` are left out."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return own.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Sessions per key: spans of events less than ``gap`` apart."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def append_new(batch: DataFrame, store: str, keys: list[str]) -> int:
    """Append rows whose keys the store does not hold; to be called per micro-batch, safe to repeat."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        fresh = fresh.join(spark.read.parquet(store).select(keys), keys, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(store)
    fresh.unpersist()
    return n
