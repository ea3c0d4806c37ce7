"""Aggregates over the world tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.sources.worlds import World, with_views


def stats(w: World):
    """All counts of a world, one pass over each table instead of a query for each count."""
    kind = lambda k: F.count_if(F.col("entity_type") == k)
    e = w.entity().groupBy("world_id").agg(F.count("*").alias("entities"), kind("building").alias("buildings"), kind("machinery").alias("machines"), kind("household").alias("households"))
    v = w.event().groupBy("world_id").agg(F.count("*").alias("events"), F.count_if(F.col("chapter_number").isNull()).alias("unassigned"))
    return w.world().select(F.col("id").alias("world_id")).join(e, "world_id", "left").join(v, "world_id", "left").fillna(0)


def character_stats(w: World):
    """Events are counted by one pass over the participations, roles and chapters gathered by another: by event in tasks of bounded
    size, with keys and counts that need no lists, before little is left for each entity."""
    p, events = w.participations(), w.event()
    n = p.select("event_id", "entity_id").distinct().join(events.select("event_id"), "event_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))
    seen = p.join(events.select("event_id", "chapter_number"), "event_id").select("entity_id", "chapter_number", F.lower("role").alias("role")).distinct()
    roles = F.array_join(F.array_sort(F.collect_set("role")), ",")
    both = seen.unionByName(n, allowMissingColumns=True).groupBy("entity_id")
    return both.agg(F.sum("n").alias("n_events"), roles.alias("roles"), F.size(F.collect_set("chapter_number")).cast("long").alias("n_chapters"))


def facets(w: World):
    """Event counts by every combination of type and chapter, with totals."""
    e = w.event().select("event_type", F.coalesce(F.col("chapter_number").cast("string"), F.lit("unassigned")).alias("chapter"))
    return e.cube("event_type", "chapter").agg(F.count("*").alias("n"), (F.grouping_id()).alias("level"))


def type_tabs(w: World):
    return w.fact_version().groupBy("chapter_number").pivot("status", ["ACTIVE", "SUPERSEDED", "CONTRADICTED"]).agg(F.count(F.lit(1))).fillna(0, ["ACTIVE", "SUPERSEDED", "CONTRADICTED"]).withColumnsRenamed({"ACTIVE": "active", "SUPERSEDED": "superseded", "CONTRADICTED": "contradicted"})


def windows(w: World):
    """Events a user and six-hour window: the batch form of the streaming count."""
    return w.raw("events").groupBy("user_id", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "n")


QUERIES = {
    "world_stats": (
        stats,
        with_views("""SELECT w.id AS world_id, coalesce(entities, 0) AS entities, coalesce(buildings, 0) AS buildings, coalesce(machines, 0) AS machines, coalesce(households, 0) AS households, coalesce(events, 0) AS events, coalesce(unassigned, 0) AS unassigned FROM world w
            LEFT JOIN (SELECT world_id, count(*) AS entities, count(*) FILTER (entity_type = 'building') AS buildings, count(*) FILTER (entity_type = 'machinery') AS machines, count(*) FILTER (entity_type = 'household') AS households FROM entity GROUP BY 1) e ON e.world_id = w.id
            LEFT JOIN (SELECT world_id, count(*) AS events, count(*) FILTER (chapter_number IS NULL) AS unassigned FROM event GROUP BY 1) v ON v.world_id = w.id""", "world", "entity", "event"),
    ),
    "active_per_world": (
        lambda w: w.fact_version().where("status = 'ACTIVE'").join(w.entity().select(F.col("id").alias("entity_id"), "world_id"), "entity_id").groupBy("world_id").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities")),
        with_views("SELECT world_id, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM fact_version f JOIN entity e ON e.id = f.entity_id WHERE status = 'ACTIVE' GROUP BY 1", "fact_version", "entity"),
    ),
    "character_stats": (
        character_stats,
        with_views("SELECT entity_id, count(DISTINCT event_id) AS n_events, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT DISTINCT unnest(list(lower(role))) AS r)) AS roles, count(DISTINCT chapter_number) AS n_chapters FROM participant JOIN event USING (event_id) GROUP BY 1", "participant", "event"),
    ),
    "chapter_groups": (
        lambda w: w.event().groupBy(F.coalesce(F.col("chapter_number").cast("string"), F.lit("unassigned")).alias("chapter")).agg(F.count("*").alias("n"), F.min("created_at").cast("date").cast("string").alias("first_day")),
        with_views("SELECT coalesce(CAST(chapter_number AS VARCHAR), 'unassigned') AS chapter, count(*) AS n, CAST(CAST(min(created_at) AS DATE) AS VARCHAR) AS first_day FROM event GROUP BY 1", "event"),
    ),
    "event_facets": (facets, with_views(", e AS (SELECT event_type, coalesce(CAST(chapter_number AS VARCHAR), 'unassigned') AS chapter FROM event) SELECT event_type, chapter, count(*) AS n, grouping(event_type) * 2 + grouping(chapter) AS level FROM e GROUP BY CUBE (event_type, chapter)", "event")),
    "status_tabs": (type_tabs, with_views("SELECT chapter_number, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'SUPERSEDED') AS superseded, count(*) FILTER (status = 'CONTRADICTED') AS contradicted FROM fact_version GROUP BY 1", "fact_version")),
    "first_appearance": (lambda w: w.fact_version().groupBy("entity_id").agg(F.min("chapter_number").alias("chapter_number")), with_views("SELECT entity_id, min(chapter_number) AS chapter_number FROM fact_version GROUP BY 1", "fact_version")),
    "next_chapter_number": (lambda w: w.event().groupBy("world_id").agg((F.coalesce(F.max("chapter_number"), F.lit(0)) + 1).alias("next_number")), with_views("SELECT world_id, coalesce(max(chapter_number), 0) + 1 AS next_number FROM event GROUP BY 1", "event")),
    "event_windows": (windows, "SELECT user_id, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H') AS start, count(*) AS n FROM events GROUP BY ALL"),
    "contradiction_severity": (
        lambda w: w.contradiction().groupBy("status", F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low").alias("severity")).agg(F.count("*").alias("n")),
        with_views("SELECT status, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM contradiction GROUP BY ALL", "contradiction"),
    ),
}
