"""The activity log as a stream, and its daily roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACTIVITY


def stream_activity(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New entries of the daily folders as they appear."""
    reader = spark.readStream.schema(f"{ACTIVITY}, date date")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def daily_rollup(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Entries and success rate per day and target; works on tables and streams.

    On a stream in append or update mode, entries later than ``late`` behind the newest are dropped once their day is closed. Complete mode
    keeps all days and drops none; ``rollup`` keeps late entries apart.
    """
    stamped = df.withWatermark("timestamp", late) if df.isStreaming else df
    return (
        stamped.groupBy(F.window("timestamp", "1 day").alias("w"), "target_level")
        .agg(F.count("*").alias("events"), F.avg(F.col("success").cast("double")).alias("success_rate"))
        .select(F.to_date("w.start").alias("day"), "target_level", "events", "success_rate")
    )
