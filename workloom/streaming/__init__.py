"""Structured Streaming over event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by hour and type, each event once; what comes later than ``late`` is left out, so state stays bounded."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))


def route(events: DataFrame, valid: Column, good: str, bad: str, checkpoint: str):
    """Writes valid events and dead letters to a folder each, as far as there are files; a batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok = F.coalesce(valid, F.lit(False))
        batch.filter(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
