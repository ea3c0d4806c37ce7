"""Merging entities: every child table is repointed by a map of ids, and what then coincides is folded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check(pairs: DataFrame, entities: DataFrame, jobs: DataFrame) -> DataFrame:
    """pairs (source_id, target_id) that may not be merged, with the reason. A source must be named once and be no target."""
    ids = entities.select("id", "world_id")
    a = pairs.join(ids.select(F.col("id").alias("source_id"), F.col("world_id").alias("_w1")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.col("world_id").alias("_w2")), "target_id", "left")
    busy = jobs.where(F.col("status").isin("queued", "processing")).select(F.col("world_id").alias("_w1"), F.lit(True).alias("_busy")).distinct()
    a = a.join(busy, "_w1", "left")
    why = F.when(F.col("source_id") == F.col("target_id"), "same entity").when(F.col("_w1").isNull() | F.col("_w2").isNull() | (F.col("_w1") != F.col("_w2")), "not found in this world").when(F.col("_busy"), "a job is running")
    return a.select("source_id", "target_id", why.alias("reason")).where("reason IS NOT NULL")


def _moved(rows: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """rows with column repointed; _was: whether it was."""
    m = pairs.select(F.col("source_id").alias(column), F.col("target_id").alias("_to"))
    return rows.join(m, column, "left").withColumn("_was", F.col("_to").isNotNull()).withColumn(column, F.coalesce("_to", column)).drop("_to")


def aliases(entities: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity_id and alias after the merge: the source's names and aliases join the target's, each once whatever its case,
    without its canonical name. entities: id, canonical_name; known: entity_id, alias."""
    own = known.select("entity_id", "alias", F.lit(0).alias("order"))
    names = entities.join(pairs.select(F.col("source_id").alias("id")), "id", "left_semi").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("alias"), F.lit(0).alias("order"))
    rows = _moved(own.unionByName(names), "entity_id", pairs).withColumns({"alias": F.trim("alias"), "order": F.when(F.col("_was"), 1).otherwise(0)}).where("alias <> ''")
    folded = rows.withColumn("_f", F.lower("alias")).join(entities.select(F.col("id").alias("entity_id"), F.lower(F.trim("canonical_name")).alias("_f")), ["entity_id", "_f"], "left_anti")
    first = F.row_number().over(W.partitionBy("entity_id", "_f").orderBy("order", "alias"))
    return folded.withColumn("_r", first).where("_r = 1").select("entity_id", "alias")


def _fold(rows: DataFrame, key: list[str]) -> DataFrame:
    """A moved ACTIVE version becomes SUPERSEDED where the target already had an ACTIVE one of that key."""
    has = F.max(F.when(~F.col("_was") & (F.col("status") == "ACTIVE"), 1).otherwise(0)).over(W.partitionBy(*key))
    return rows.withColumn("status", F.when(F.col("_was") & (F.col("status") == "ACTIVE") & (has == 1), "SUPERSEDED").otherwise(F.col("status"))).drop("_was")


def facts(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fact versions after the merge; properties are the same if they are but for case and outer white space."""
    rows = _moved(versions, "entity_id", pairs).withColumn("_p", F.lower(F.trim("property_name")))
    return _fold(rows, ["entity_id", "_p"]).drop("_p")


def participants(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Participations after the merge; a moved one goes where the target takes part in the event already."""
    moved = _moved(rows, "entity_id", pairs)
    there = F.max(F.when(~F.col("_was"), 1).otherwise(0)).over(W.partitionBy("event_id", "entity_id"))
    order = F.row_number().over(W.partitionBy("event_id", "entity_id", "_was").orderBy("role"))
    return moved.withColumns({"_there": there, "_r": order}).where("not _was OR (_there = 0 AND _r = 1)").drop("_was", "_there", "_r")


def relations(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relationship versions after the merge: relations between source and target go, then outgoing ones fold into the target's,
    then incoming ones."""
    m = pairs.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
    a = versions.join(m.withColumnsRenamed({"_s": "source_id", "_t": "_a"}), "source_id", "left").join(m.withColumnsRenamed({"_s": "target_id", "_t": "_b"}), "target_id", "left")
    touched = pairs.select("target_id").distinct().select(F.col("target_id").alias("_end"), F.lit(True).alias("_merged"))
    ends = a.withColumns({"_x": F.coalesce("_a", "source_id"), "_y": F.coalesce("_b", "target_id")}).join(touched, F.col("_x") == F.col("_end"), "left")
    kept = ends.where((F.col("_x") != F.col("_y")) | F.col("_merged").isNull()).select(*versions.columns)
    out = _fold(_moved(kept, "source_id", pairs), ["source_id", "target_id"])
    return _fold(_moved(out, "target_id", pairs), ["source_id", "target_id"]).select(*versions.columns)


def orphans(contradictions: DataFrame, refs: list[str]) -> DataFrame:
    """contradictions without those that refer to nothing any more."""
    return contradictions.where(F.coalesce(*refs).isNotNull())
