"""Chapters and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events (ts, user_id) a user and window; state for a window goes once no event that late can come."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """Findings (ts, signature) once each within the time that repeats can arrive."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["signature"])


def in_order(chapters: DataFrame, integrate: Callable[[int, DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Calls integrate(chapter_number, rows) for each chapter of each batch, in ascending order, once a batch is checkpointed.

    An earlier chapter that comes late is integrated when it comes: versions are judged anew from all of them, so no watermark
    may drop it.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        for (n,) in sorted(rows.select("chapter_number").distinct().collect()):
            integrate(n, rows.where(F.col("chapter_number") == n))
        rows.unpersist()

    return chapters.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
