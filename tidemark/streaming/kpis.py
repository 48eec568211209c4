"""Key figures of impressions as they arrive, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_kpis(behaviors: DataFrame, *, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(window_start, impressions, candidates, clicks, ctr, users) for a stream, or a batch, of
    impressions with their slates.

    A slate is counted where it stands, so nothing is exploded and the state is a row for
    each open window. Impressions later than ``lateness`` are dropped by the watermark.
    ``users`` is approximate: a stream has no exact distinct count.
    """
    clicked = F.size(F.array_intersect(F.coalesce("article_ids_clicked", F.array().cast("array<bigint>")), "article_ids_inview"))
    rows = behaviors.select(
        F.col("impression_time").cast("timestamp").alias("time"), "user_id", F.size("article_ids_inview").alias("candidates"), clicked.alias("clicks")
    ).withWatermark("time", lateness)
    out = rows.groupBy(F.window("time", window)).agg(
        F.count("*").alias("impressions"),
        F.sum("candidates").alias("candidates"),
        F.sum("clicks").alias("clicks"),
        F.approx_count_distinct("user_id").alias("users"),
    )
    ctr = F.try_divide(F.col("clicks").cast("double"), F.col("candidates"))
    return out.select(F.col("window.start").alias("window_start"), "impressions", "candidates", "clicks", ctr.alias("ctr"), "users")
