"""Streamed step counts: events in windows of training time, late ones up to the watermark. Nothing of the kind is in the
batch catalogue's model; the counts feed the same step operators through ``foreachBatch`` or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def token_windows(events: DataFrame, window: str = "3 days", late: str = "1 day", slide: str | None = None, origin: str = "1 day") -> DataFrame:
    """(start, label, token, n) per window; tumbling unless ``slide`` is given. Windows begin ``origin`` after the epoch:
    a day makes three-day windows begin on 1 January 2024, as the batch steps do."""
    token = events.withWatermark("ts", late).select("ts", (F.col("user_id") % 6).alias("label"), F.get_json_object("props", "$.k").alias("token")).where("token IS NOT NULL")
    at = F.window("ts", window, slide or window, origin)
    return token.groupBy(at.alias("w"), "label", "token").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "token", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, user_id, n) of each user's runs of events without a longer gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")
