"""Edits of the world tables, and events from a token table made of conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.operators import edits, extraction
from loreline.operators import versions as ver
from loreline.sources.worlds import World, with_views


def added(w: World):
    new = w.fact_version().where("version_id % 50 = 0").select((-F.col("version_id") - 1).alias("version_id"), "entity_id", "property_name", "value", "created_at", "chapter_number").dropDuplicates(["entity_id", "property_name"])
    return edits.add_facts(w.fact_version(), new).groupBy("entity_id", "property_name", "status").agg(F.count("*").alias("n"))


def unlinked(w: World):
    gone = w.event().where("world_id = 3").select("chapter_number").where("chapter_number IS NOT NULL AND chapter_number <= 4").distinct()
    return edits.unlink(w.fact_version(), gone, "chapter_number").groupBy("chapter_number").agg(F.count("*").alias("n"))


def cascaded(w: World):
    return edits.without(w.relationship_version(), w.entity().where("entity_type = 'household'").select("id"), "source_id", "target_id").select("version_id", "source_id", "target_id")


def said_already(w: World):
    now = ver.current_active(w.relationship_version(), ["source_id", "target_id"]).select("source_id", "target_id", "relationship_type")
    new = w.relationship_version().where("version_id % 3 = 0").select("version_id", "source_id", "target_id", F.lower("relationship_type").alias("relationship_type"))
    return edits.rejected_relations(now, new).select("version_id")


def moved(w: World):
    to = w.event().where("event_id % 10 = 0").select("event_id", (F.col("event_id") % 12 + 1).cast("int").alias("chapter_number"))
    return edits.move_events(w.event(), to).select("event_id", "chapter_number", "sequence_index")


def wrong_participants(w: World):
    p = w.raw("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"), (F.col("l_suppkey") % 25).alias("world_id"))
    return edits.participant_errors(p, w.entity().select("id", "world_id")).groupBy("error").agg(F.count("*").alias("n"))


def mentions(w: World):
    """Spans of events: user and day give the place, the value the confidence."""
    e = w.raw("events").select((F.col("user_id") % 30).alias("doc_id"), F.dayofmonth("ts").alias("start"), (F.dayofmonth("ts") + F.length("event_type")).alias("end"), F.col("event_type").alias("type"), F.col("value").alias("confidence"), F.when(F.col("event_id") % 9 == 0, "pronominal").otherwise("proper").alias("kind"), F.col("event_id").alias("seen"))
    return extraction.build_mentions(e, 5.0).select("doc_id", "mention_id", "start", "end", "type")


def tokens(w: World):
    """Words of the turns with a parse by position: every third word hangs on the word after it as subject, and so on."""
    rel = F.element_at(F.array(*[F.lit(x) for x in ("nsubj", "ROOT", "dobj", "mark", "advcl", "conj")]), (F.col("i") % 6 + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(x) for x in (1, 0, -1, 1, -3, -5)]), (F.col("i") % 6 + 1).cast("int")) + F.col("i")
    words = w.raw("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "word"))
    lemma = F.when(F.col("i") % 6 == 1, "say").when(F.col("i") % 6 == 4, "leave").when(F.col("i") % 12 == 3, "before").when(F.col("i") % 12 == 9, "while").otherwise(F.lower("word"))
    return words.select("doc_id", F.col("i").alias("token_id"), "word", lemma.alias("lemma"), F.when(F.col("i") % 3 == 1, "VERB").otherwise("NOUN").alias("pos"), rel.alias("rel"), head.cast("int").alias("head"), (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 5).alias("end"), (F.col("i") % 6).isin(1, 4).alias("event"))


def token_events(w: World):
    return extraction.find_events(tokens(w)).groupBy("type").agg(F.count("*").alias("n"))


def token_times(w: World):
    t = tokens(w)
    return extraction.temporal_relations(extraction.find_events(t), t).groupBy("relation").agg(F.count("*").alias("n"))


def token_participants(w: World):
    t = tokens(w)
    m = t.where("pos = 'NOUN'").select("doc_id", F.concat(F.lit("M"), "token_id").alias("mention_id"), F.lit("character").alias("type"), "start", "end")
    return extraction.participants(extraction.find_events(t), t, m).groupBy("role").agg(F.count("*").alias("n"))


QUERIES = {
    "manual_fact_add": (
        added,
        with_views(""", k AS (SELECT DISTINCT entity_id, property_name FROM fact_version WHERE version_id % 50 = 0),
            a AS (SELECT f.entity_id, f.property_name, CASE WHEN k.entity_id IS NOT NULL AND status = 'ACTIVE' THEN 'SUPERSEDED' ELSE status END AS status FROM fact_version f LEFT JOIN k ON k.entity_id = f.entity_id AND k.property_name = f.property_name UNION ALL SELECT entity_id, property_name, 'ACTIVE' FROM k)
            SELECT entity_id, property_name, status, count(*) AS n FROM a GROUP BY ALL""", "fact_version"),
    ),
    "deleted_chapter_unlinks": (unlinked, with_views("SELECT CASE WHEN chapter_number IN (SELECT chapter_number FROM event WHERE world_id = 3 AND chapter_number <= 4) THEN NULL ELSE chapter_number END AS chapter_number, count(*) AS n FROM fact_version GROUP BY 1", "fact_version", "event")),
    "deleted_entities_cascade": (cascaded, with_views("SELECT version_id, source_id, target_id FROM relationship_version WHERE source_id NOT IN (SELECT id FROM entity WHERE entity_type = 'household') AND target_id NOT IN (SELECT id FROM entity WHERE entity_type = 'household')", "relationship_version", "entity")),
    "relation_said_already": (
        said_already,
        with_views(", now AS (SELECT * FROM relationship_version WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at DESC, version_id DESC) = 1) SELECT r.version_id FROM relationship_version r JOIN now n ON n.source_id = r.source_id AND n.target_id = r.target_id AND n.relationship_type = r.relationship_type WHERE r.version_id % 3 = 0", "relationship_version"),
    ),
    "moved_events": (
        moved,
        with_views("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_id % 12 + 1 ELSE chapter_number END AS chapter_number, CASE WHEN event_id % 10 = 0 AND chapter_number IS DISTINCT FROM event_id % 12 + 1 THEN NULL ELSE sequence_index END AS sequence_index FROM event", "event"),
    ),
    "participant_errors": (
        wrong_participants,
        with_views(", p AS (SELECT l_orderkey AS event_id, l_suppkey AS entity_id, l_suppkey % 25 AS world_id FROM lineitem) SELECT 'listed twice' AS error, count(*) AS n FROM (SELECT event_id, entity_id FROM p GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'not in this world', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM entity e WHERE e.id = p.entity_id AND e.world_id = p.world_id)", "entity"),
    ),
    "build_mentions": (
        mentions,
        """WITH e AS (SELECT user_id % 30 AS doc_id, day(ts) AS s, day(ts) + length(event_type) AS e, event_type AS type, value AS c, CASE WHEN event_id % 9 = 0 THEN 'pronominal' ELSE 'proper' END AS kind, event_id AS seen FROM events WHERE value >= 5),
            b AS (SELECT doc_id, s, e, arg_max(type, (c, -seen)) AS type, arg_max(kind, (c, -seen)) AS kind FROM e GROUP BY ALL)
            SELECT doc_id, 'M' || row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS mention_id, s AS start, e AS "end", type FROM b WHERE kind <> 'pronominal'""",
    ),
    "token_events": (
        token_events,
        r"""WITH t AS (SELECT unnest(range(len(string_split_regex(trim(text), '\s+')))) AS i FROM conversations) SELECT CASE i % 6 WHEN 1 THEN 'CONVERSATION' ELSE 'DEPARTURE' END AS type, count(*) AS n FROM t WHERE i % 6 IN (1, 4) GROUP BY 1""",
    ),
    "token_times": (
        token_times,
        r"""WITH t AS (SELECT unnest(range(len(string_split_regex(trim(text), '\s+')))) AS i FROM conversations) SELECT CASE i % 12 WHEN 4 THEN 'BEFORE' ELSE 'DURING' END AS relation, count(*) AS n FROM t WHERE i % 6 = 4 GROUP BY 1""",
    ),
    "token_participants": (token_participants, None),
}
