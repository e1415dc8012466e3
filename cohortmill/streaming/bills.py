"""Streams of bills and events: an addition to the batch engine, over the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def drop_folder(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(lines: DataFrame, keys: list[str], ts: str = "event_ts", late: str = "1 day") -> DataFrame:
    """One row for each key within the time that rows may be late."""
    return lines.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str = "event_ts", by: str = "event_name", size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window; a window is given out once it can get no more rows."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, user: str, ts: str = "event_ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
