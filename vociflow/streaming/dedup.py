"""A streaming form of exact duplicate detection: an extension, as the batch operators have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vociflow.functions.text import dedup_key
from vociflow.params import DEFAULT, Params


def first_texts(posts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Posts of a stream whose normalised text was not seen within the time window before.

    State is one hash for each text within the window, as the watermark lets older ones go.
    """
    rows = posts.where(F.length("text") >= p.exact_min_length).withColumn("text_key", dedup_key(F.col("text")))
    return rows.withWatermark("published_at", f"{p.near_hours} hours").dropDuplicatesWithinWatermark(["text_key"])


def windowed_counts(posts: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """Posts of each author in consecutive windows of a stream."""
    return posts.withWatermark("published_at", late).groupBy(F.window("published_at", f"{days} days"), "from_id").agg(F.count("*").alias("n"))
