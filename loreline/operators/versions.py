"""Operators over versioned facts and relationships. Columns: version_id, created_at, chapter_number, status and a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(versions: DataFrame, key: list[str], *first: Column) -> DataFrame:
    """One row a key: the newest by created_at, then version_id; columns in first decide before."""
    order = [*first, F.col("created_at").desc_nulls_last(), F.col("version_id").desc()]
    return versions.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def current_active(versions: DataFrame, key: list[str]) -> DataFrame:
    """The newest ACTIVE version of each key; keys without one are absent."""
    return newest(versions.where("status = 'ACTIVE'"), key)


def current_or_latest(versions: DataFrame, key: list[str]) -> DataFrame:
    """The newest ACTIVE version, else the newest of any status."""
    return newest(versions, key, F.when(F.col("status") == "ACTIVE", 0).otherwise(1).asc())


def latest_if_active(versions: DataFrame, key: list[str]) -> DataFrame:
    """The newest version of any status, of those keys where it is ACTIVE."""
    return newest(versions, key).where("status = 'ACTIVE'")


def excluded_versions(contradictions: DataFrame, old: str, new: str) -> DataFrame:
    """version_id and status of versions that as-of slices leave out: both sides of a DETECTED contradiction while
    CONTRADICTED, the new side of a RESOLVED one while SUPERSEDED."""
    detected = contradictions.where("status = 'DETECTED'").select(F.explode(F.array(old, new)).alias("version_id")).withColumn("status", F.lit("CONTRADICTED"))
    rejected = contradictions.where("status = 'RESOLVED'").select(F.col(new).alias("version_id")).withColumn("status", F.lit("SUPERSEDED"))
    return detected.unionByName(rejected).where("version_id IS NOT NULL").distinct()


def as_of(versions: DataFrame, key: list[str], chapter: int, excluded: DataFrame | None = None) -> DataFrame:
    """The version of each key that holds as of a chapter: of those up to it, or without one, the largest chapter (none
    counts as 0), then the newest."""
    seen = versions.where(F.col("chapter_number").isNull() | (F.col("chapter_number") <= chapter))
    if excluded is not None:
        seen = seen.join(excluded, ["version_id", "status"], "left_anti")
    return newest(seen, key, F.coalesce("chapter_number", F.lit(0)).desc())


def _in_order(key: list[str]):
    return W.partitionBy(*key).orderBy(F.col("created_at").asc(), F.col("version_id").asc())


def history(versions: DataFrame, key: list[str]) -> DataFrame:
    """Every version with its place from the oldest on (from 0) and the versions before and after it."""
    w = _in_order(key)
    return versions.withColumns({"place": F.row_number().over(w) - 1, "previous_id": F.lag("version_id").over(w), "next_id": F.lead("version_id").over(w)})


def last_active_before(versions: DataFrame, key: list[str], value: Column, usable: Column | None = None) -> DataFrame:
    """Every version with reference_id and reference_value: of the last ACTIVE (and usable) version older than it."""
    w = _in_order(key).rowsBetween(W.unboundedPreceding, -1)
    good = (F.col("status") == "ACTIVE") if usable is None else (F.col("status") == "ACTIVE") & usable
    found = F.last(F.when(good, F.struct(F.col("version_id").alias("id"), value.alias("value"))), ignorenulls=True).over(w)
    return versions.withColumn("_ref", found).withColumns({"reference_id": F.col("_ref.id"), "reference_value": F.col("_ref.value")}).drop("_ref")


def nearest_chapters(versions: DataFrame, key: list[str], value: Column, usable: Column) -> DataFrame:
    """Every version with the usable one of the nearest earlier chapter (its newest) and of the nearest later chapter (its
    oldest), among ACTIVE and SUPERSEDED versions with a chapter: before_ and after_ id, chapter and value."""
    good = F.col("status").isin("ACTIVE", "SUPERSEDED") & F.col("chapter_number").isNotNull() & usable
    here = F.struct(F.col("version_id").alias("id"), F.col("chapter_number").alias("chapter"), value.alias("value"))
    place = F.row_number().over(_in_order(key))
    ranked = versions.withColumn("_place", place)
    chapters = (
        ranked.where(good).groupBy(*key, "chapter_number").agg(F.max_by(here, "_place").alias("newest"), F.min_by(here, "_place").alias("oldest"))
    )
    all_chapters = versions.where("chapter_number IS NOT NULL").select(*key, "chapter_number").distinct()
    w = W.partitionBy(*key).orderBy("chapter_number")
    near = (
        all_chapters.join(chapters, [*key, "chapter_number"], "left")
        .withColumn("before", F.last("newest", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("after", F.first("oldest", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
        .select(*key, "chapter_number", "before", "after")
    )
    out = versions.join(near, [*key, "chapter_number"], "left")
    return out.withColumns({f"{side}_{c}": F.col(f"{side}.{c}") for side in ("before", "after") for c in ("id", "chapter", "value")}).drop("before", "after")


def statuses_after_writes(versions: DataFrame, key: list[str], value: str, conflicting: Column) -> DataFrame:
    """Status of each version if all are written in order: a conflicting write is CONTRADICTED and leaves the others; an
    equal or first value is ACTIVE; another value supersedes the ACTIVE ones before it. stored: resulting status."""
    w = _in_order(key)
    clean = versions.withColumn("_bad", conflicting).withColumn("_prev", F.last(F.when(~conflicting, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    opens = ~F.col("_bad") & (F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value)))
    run = F.sum(F.when(opens, 1).otherwise(0)).over(w)
    clean = clean.withColumn("_run", run)
    last = F.max("_run").over(W.partitionBy(*key))
    return clean.withColumn("stored", F.when(F.col("_bad"), "CONTRADICTED").when(F.col("_run") == last, "ACTIVE").otherwise("SUPERSEDED")).drop("_bad", "_prev", "_run")


def next_number(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    return rows.groupBy(*key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))
