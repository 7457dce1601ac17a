"""Streaming ingest of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attnmaps.functions.paths import image_key


def first_submissions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each user and image path within the watermark.

    State is kept for ``delay`` only. The batch job's order by time decides among all
    submissions; here the first to arrive counts.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "image_path"])


def running_counts(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, image_key, n): submissions by image and window, late ones within the delay."""
    rows = stream.withWatermark("ts", delay).withColumn("image_key", image_key(F.col("image_path")))
    return rows.groupBy(F.window("ts", window), "image_key").agg(F.count(F.lit(1)).alias("n"))
