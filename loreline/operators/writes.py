"""Writes around a world: get or create, rows with their defaults, jobs that claim and fail, uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.operators import texts

#: What a row has where nothing is given.
DEFAULTS = {"status": "ACTIVE", "confidence": 1.0, "event_type": "EVENT", "role": "PARTICIPANT"}


def get_or_create(stored: DataFrame, wanted: DataFrame, key: list[str], ident: Column) -> DataFrame:
    """stored (id and key) with a row for each wanted key it lacks; repeated keys are made once and ids follow from the key, so a
    repeated write adds nothing."""
    fresh = wanted.select(*key).distinct().join(stored.select(*key), key, "left_anti")
    return stored.unionByName(fresh.withColumn("id", ident).select(stored.columns))


def with_defaults(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """rows with all columns of schema: DEFAULTS where a value is missing or null, else null."""
    types = dict(schema.dtypes)

    def column(name: str) -> Column:
        default = F.lit(DEFAULTS.get(name)).cast(types[name])
        return (F.coalesce(F.col(name), default) if name in rows.columns else default).cast(types[name]).alias(name)

    return rows.select(*[column(c) for c in types])


def append(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """stored with rows that it lacks by key, and their defaults."""
    return stored.unionByName(with_defaults(rows, stored).join(stored.select(key), key, "left_anti"))


def claim(runs: DataFrame, run_id: int, worker: str) -> DataFrame:
    """runs after a worker asks for one: only a PENDING run becomes PROCESSING, and its. The caller writes the result as a new
    table version and has the run if the row names it; a run that is DONE stays so whoever asks."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "PENDING")
    return runs.withColumns({"worker": F.when(mine, worker).otherwise(F.col("worker")), "status": F.when(mine, "PROCESSING").otherwise(F.col("status"))})


def finish(runs: DataFrame, results: DataFrame) -> DataFrame:
    """runs after results (run_id, status, error); a DONE run is never overwritten."""
    new = results.select("run_id", F.col("status").alias("to"), F.col("error").alias("why"))
    open_ = F.col("to").isNotNull() & (F.col("status") != "DONE")
    out = runs.join(new, "run_id", "left").withColumns({"error": F.when(open_, F.col("why")).otherwise(F.col("error")), "status": F.when(open_, F.col("to")).otherwise(F.col("status"))})
    return out.select(runs.columns)


def fail_pending(runs: DataFrame, job_id: int, error: str) -> DataFrame:
    """runs after a job broke off: those of it that never came to an end are FAILED with the error."""
    open_ = (F.col("job_id") == job_id) & F.col("status").isin("PENDING", "PROCESSING")
    return runs.withColumns({"error": F.when(open_, error).otherwise(F.col("error")), "status": F.when(open_, "FAILED").otherwise(F.col("status"))})


def run_chapter(work: Callable[[], None], status: str) -> tuple[str, str | None]:
    """Runs one chapter's work and says how it ended: never raises; a DONE chapter is skipped."""
    if status == "DONE":
        return "skipped", None
    try:
        work()
    except Exception as error:  # the job goes on to report it
        return "FAILED", f"{type(error).__name__}: {error}"
    return "DONE", None


def upload(manuscripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an upload (manuscript_id, text): manuscripts with the hash of their text, and their chapters as first, current
    versions with the hash of theirs. Numbers follow the headings; ids follow from manuscript and number."""
    hashed = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256)
    heads = manuscripts.select("manuscript_id", hashed("text").alias("content_hash"))
    parts = texts.split_chapters(manuscripts, "manuscript_id", "text")
    chapters = parts.select(
        F.concat_ws("-", F.col("manuscript_id").cast("string"), F.col("chapter_number").cast("string")).alias("chapter_id"), "manuscript_id", "chapter_number", "title",
        F.lit(1).alias("version_number"), F.lit(True).alias("is_current"), hashed("content").alias("content_hash"), "content",
    )
    return heads, chapters
