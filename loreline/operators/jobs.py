"""State of extraction jobs and runs, and the order of chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rollup(runs: DataFrame) -> DataFrame:
    """job_id, completed, total, status and error: FAILED with the first error if any run failed, DONE if all are done. A
    recount of the runs, so repeating it changes nothing."""
    failed, done = F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status") == "DONE")
    out = runs.groupBy("job_id").agg(
        done.alias("completed"), F.count("*").alias("total"), failed.alias("failed"), F.min_by(F.when(F.col("status") == "FAILED", F.col("error")), F.when(F.col("status") == "FAILED", F.struct("created_at", "run_id"))).alias("error")
    )
    status = F.when(F.col("failed") > 0, "FAILED").when(F.col("completed") == F.col("total"), "DONE").otherwise("PROCESSING")
    return out.select("job_id", "completed", "total", status.alias("status"), "error")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each chapter (manuscript_id, chapter_number)."""
    w = W.partitionBy("manuscript_id", "chapter_number").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def blocked(runs: DataFrame) -> DataFrame:
    """manuscript_id, chapter_number and n_blockers: lower chapters of the manuscript whose newest run is not DONE."""
    w = W.partitionBy("manuscript_id").orderBy("chapter_number").rowsBetween(W.unboundedPreceding, -1)
    return latest_run(runs).select("manuscript_id", "chapter_number", F.coalesce(F.sum(F.when(F.col("status") != "DONE", 1).otherwise(0)).over(w), F.lit(0)).alias("n_blockers"))


def after_first_failure(chapters: DataFrame) -> DataFrame:
    """chapters (job_id, chapter_number, ok) with outcome: done up to the first failure, failed there, skipped behind it."""
    w = W.partitionBy("job_id")
    first = F.min(F.when(~F.col("ok"), F.col("chapter_number"))).over(w)
    return chapters.withColumn("outcome", F.when(first.isNull() | (F.col("chapter_number") < first), "done").when(F.col("chapter_number") == first, "failed").otherwise("skipped"))


def latest_state(events: DataFrame) -> DataFrame:
    """The last recorded state of each job (job_id, state, at, seq)."""
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"))


def reorder(events: DataFrame, wanted: DataFrame, scope: list[str]) -> DataFrame:
    """New sequence_index of events by wanted (scope, ids array): their place in the list. Scopes whose list is not exactly the
    set of their events keep what they have."""
    have = events.groupBy(*scope).agg(F.array_sort(F.collect_set("event_id")).alias("_have"))
    good = wanted.join(have, scope).where(F.array_sort("ids") == F.col("_have"))
    place = good.select(*scope, F.posexplode("ids").alias("_place", "event_id"))
    return events.join(place, [*scope, "event_id"], "left").withColumn("sequence_index", F.coalesce("_place", "sequence_index")).drop("_place")


def current_versions(versions: DataFrame, key: list[str]) -> DataFrame:
    """Chapter versions with is_current on the highest version number of each chapter alone."""
    return versions.withColumn("is_current", F.row_number().over(W.partitionBy(*key).orderBy(F.col("version_number").desc(), F.col("version_id").desc())) == 1)
