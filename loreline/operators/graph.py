"""Knowledge graph, timeline and entity detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import versions as ver

#: Reasons for which a chapter counts as an appearance, the strongest first.
REASONS = ("event", "fact", "relationship", "mention")


def edges_latest(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """Every pair as an edge: its newest ACTIVE type, RELATED_TO with confidence 1 where there is none."""
    now = ver.current_active(versions, ["source_id", "target_id"]).select("source_id", "target_id", "relationship_type", "chapter_number")
    return pairs.join(now, ["source_id", "target_id"], "left").select("source_id", "target_id", F.coalesce("relationship_type", F.lit("RELATED_TO")).alias("relationship_type"), "chapter_number")


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree: edges at both ends; a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def nodes_as_of(entities: DataFrame, chapter: int, edges: DataFrame, facts: DataFrame, fact_versions: DataFrame, relation_versions: DataFrame, mentions: DataFrame, participations: DataFrame) -> DataFrame:
    """Entities of the graph as of a chapter, with degree and n_facts: those with an edge or a fact as of it, with a mention up
    to it, or with no data of any chapter at all.

    edges and facts: slices as of the chapter; the others: all versions, mentions (entity_id, chapter_number) and event
    participations (entity_id, chapter_number).
    """
    degree = degrees(edges)
    known = facts.groupBy("entity_id").agg(F.count("*").alias("n_facts"))
    seen = mentions.where(F.col("chapter_number") <= chapter).select(F.col("entity_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    in_chapters = [
        fact_versions.where("chapter_number IS NOT NULL").select(F.col("entity_id").alias("id")),
        relation_versions.where("chapter_number IS NOT NULL").select(F.explode(F.array("source_id", "target_id")).alias("id")),
        mentions.select(F.col("entity_id").alias("id")),
        participations.where("chapter_number IS NOT NULL").select(F.col("entity_id").alias("id")),
    ]
    tagged = in_chapters[0]
    for more in in_chapters[1:]:
        tagged = tagged.unionByName(more)
    tagged = tagged.distinct().withColumn("tagged", F.lit(True))
    out = entities.join(degree, "id", "left").join(known.withColumnRenamed("entity_id", "id"), "id", "left").join(seen, "id", "left").join(tagged, "id", "left")
    shown = F.col("degree").isNotNull() | F.col("n_facts").isNotNull() | F.col("seen").isNotNull() | F.col("tagged").isNull()
    return out.where(shown).select(*entities.columns, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def timeline_order() -> list[Column]:
    """Events without a chapter first; missing sequence or position last within their chapter."""
    return [
        F.col("chapter_number").asc_nulls_first(), F.col("sequence_index").asc_nulls_last(), F.col("start_position").asc_nulls_last(),
        F.col("created_at").asc_nulls_first(), F.col("event_id").asc(),
    ]


def timeline(events: DataFrame, *scope: str) -> DataFrame:
    """events with place (from 1) in the timeline of their scope; without a scope, rank a bounded world at a time."""
    return events.withColumn("place", F.row_number().over(W.partitionBy(*scope).orderBy(*timeline_order())))


def recent_events(events: DataFrame, n: int) -> DataFrame:
    """The last n events of the timeline by chapter, newest first; missing values last. A top-k: no full sort."""
    return events.orderBy(F.col("chapter_number").desc_nulls_last(), F.col("sequence_index").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("event_id").desc()).limit(n)


def appearances(events: DataFrame, facts: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """entity_id, chapter_number and reason: the strongest reason for which an entity appears in a chapter. Of events (with event_id and
    event_type) the last one counts and gives its type. Each side is one row an entity and chapter before they meet."""
    key = ["entity_id", "chapter_number"]
    last = F.concat(F.lit("Event: "), F.max_by("event_type", "event_id"))
    parts = []
    for rank, (reason, rows) in enumerate(zip(REASONS, (events, facts, relations, mentions), strict=True)):
        told = last if reason == "event" else F.lit(reason)
        parts.append(rows.where("chapter_number IS NOT NULL").groupBy(*key).agg(told.alias("reason")).withColumn("rank", F.lit(rank)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*key).agg(F.min_by("reason", "rank").alias("reason"))


def co_stars(participants: DataFrame) -> DataFrame:
    """entity_id, other_id and n_events for entities that take part in the same event. An event is one sorted list of its entities, which
    gives each pair once; the pair is turned round when all events are counted."""
    casts = participants.where("event_id IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("_c"))
    firsts = casts.select(F.posexplode("_c").alias("_i", "a"), "_c").select("a", F.explode(F.slice("_c", F.col("_i") + 2, F.size("_c"))).alias("b"))
    pairs = firsts.groupBy("a", "b").agg(F.count("*").alias("n_events"))
    both = F.explode(F.array(F.struct(F.col("a").alias("entity_id"), F.col("b").alias("other_id")), F.struct(F.col("b").alias("entity_id"), F.col("a").alias("other_id")))).alias("p")
    return pairs.select(both, "n_events").select("p.*", "n_events")


def relations_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations at either end of the given entities (id), each once: two equality joins instead of one with OR."""
    ids = entities.select(F.col("id").alias("_id")).distinct()
    out = relations.join(ids, relations["source_id"] == ids["_id"], "left_semi")
    into = relations.join(ids, relations["target_id"] == ids["_id"], "left_semi")
    return out.unionByName(into).dropDuplicates(["version_id"])


def chapter_steps(chapters: DataFrame, *scope: str) -> DataFrame:
    """Distinct chapter numbers of a scope with the one before and after."""
    w = W.partitionBy(*scope).orderBy("chapter_number")
    rows = chapters.where("chapter_number IS NOT NULL").select(*scope, "chapter_number").distinct()
    return rows.withColumns({"previous": F.lag("chapter_number").over(w), "next": F.lead("chapter_number").over(w)})
