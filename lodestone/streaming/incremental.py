"""Incremental upkeep: each micro-batch of delivered rows becomes the next state of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row a key: the latest, by its own columns where times are equal."""
    others = [c for c in df.columns if c not in (key, at)]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *others)).alias("r")).select(key, *[f"r.{c}" for c in df.columns if c != key])


def keep_latest(spark: SparkSession, source: DataFrame, key: str, at: str, state: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Streams source into the table at ``state``, one row a key.

    Every batch writes a new version of the state beside the old ones, state/version=N, from the one before; a batch
    that is run again after a failure writes the same version again, so nothing counts twice.
    """

    def merge(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        rows = batch
        if n > 0:
            rows = s.read.schema(batch.schema).parquet(f"{state}/version={n - 1}").unionByName(batch)
        latest(rows, key, at).select(batch.columns).write.mode("overwrite").parquet(f"{state}/version={n}")

    w = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def event_rates(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by kind and window, with a watermark for late rows; works on a stream as on a table."""
    t = F.col(at).cast("timestamp")
    return events.withColumn("at", t).withWatermark("at", late).groupBy(F.window("at", window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), kind, "n")
