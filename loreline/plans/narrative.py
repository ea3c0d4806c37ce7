"""Versions, rules, graph and timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import graph, rules
from loreline.operators import versions as ver
from loreline.sources.worlds import World, with_views

FACT = ["entity_id", "property_name"]
PAIR = ["source_id", "target_id"]
N = 10

_EXCLUDED = """, excluded AS (
    SELECT old_fact_version_id AS version_id, 'CONTRADICTED' AS status FROM contradiction WHERE status = 'DETECTED'
    UNION SELECT new_fact_version_id, 'CONTRADICTED' FROM contradiction WHERE status = 'DETECTED'
    UNION SELECT new_fact_version_id, 'SUPERSEDED' FROM contradiction WHERE status = 'RESOLVED')"""
_SLICE = """, fact_slice AS (
    SELECT * FROM fact_version f WHERE (chapter_number IS NULL OR chapter_number <= 10)
        AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.version_id = f.version_id AND x.status = f.status)
    QUALIFY row_number() OVER (PARTITION BY entity_id, property_name ORDER BY coalesce(chapter_number, 0) DESC, created_at DESC, version_id DESC) = 1)"""
_EDGE_SLICE = """, edge_slice AS (
    SELECT * FROM relationship_version WHERE chapter_number IS NULL OR chapter_number <= 6
    QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY coalesce(chapter_number, 0) DESC, created_at DESC, version_id DESC) = 1)"""


def fact_slice(w: World):
    return ver.as_of(w.fact_version(), FACT, N, ver.excluded_versions(w.contradiction(), "old_fact_version_id", "new_fact_version_id"))


def edge_slice(w: World):
    return ver.as_of(w.relationship_version(), PAIR, 6)


def pairs(w: World):
    return w.relationship_version().select(*PAIR).distinct()


def participations(w: World):
    return w.participant().join(w.event().select("event_id", "chapter_number"), "event_id")


def nodes_asof(w: World):
    entities = w.entity().select("id", "canonical_name", "entity_type")
    out = graph.nodes_as_of(entities, N, edge_slice(w), fact_slice(w), w.fact_version(), w.relationship_version(), w.mention(), participations(w))
    return out.select("id", "canonical_name", "entity_type", "degree", "n_facts")


def age(w: World):
    return S.age_of_number(F.floor(F.col("value")))


def state():
    return F.when(F.col("value") < 10, "DEAD").when(F.col("value") > 90, "ALIVE")


def appearances(w: World):
    rel = w.relationship_version().select(F.explode(F.array("source_id", "target_id")).alias("entity_id"), "chapter_number")
    return graph.appearances(w.participant().join(w.event().select("event_id", "chapter_number", "event_type"), "event_id"), w.fact_version(), rel, w.mention())


def immutable(w: World):
    return rules.immutable_fact(w.fact_version().withColumn("value", F.floor("value").cast("string")), FACT, immutable=F.col("property_name").isin("signup", "error"))


def decided(w: World):
    """Claims of resolved or dismissed contradictions, by a signature that no version id is part of."""
    f = w.fact_version().select("version_id", *FACT, F.floor("value").cast("string").alias("v"))
    c = w.contradiction().where("status <> 'DETECTED'")
    old, new = f.select(F.col("version_id").alias("old_fact_version_id"), F.col("v").alias("old_v")), f.withColumnsRenamed({"version_id": "new_fact_version_id", "v": "new_v"})
    both = c.join(old, "old_fact_version_id").join(new, "new_fact_version_id")
    return both.select("entity_id", "property_name", F.least("old_v", "new_v").alias("a"), F.greatest("old_v", "new_v").alias("b")).distinct()


def new_findings(w: World):
    """Findings of the immutable rule that no contradiction records yet."""
    recorded = w.contradiction().select(F.lit("IMMUTABLE_FACT").alias("rule_id"), F.col("old_fact_version_id").alias("old_version_id"), F.col("new_fact_version_id").alias("new_version_id"))
    return rules.record(immutable(w), recorded, ["old_version_id", "new_version_id"]).select("old_version_id", "new_version_id")


def resolved(w: World):
    decisions = w.contradiction().where("status = 'RESOLVED'").select(F.col("new_fact_version_id").alias("chosen_id"), F.col("old_fact_version_id").alias("other_id"))
    return rules.resolve(w.fact_version(), decisions).groupBy("status").agg(F.count("*").alias("n"))


def cycles(w: World):
    """Lines of an order as events: each comes before the next, told from either end; the last one before the first if it was returned."""
    from pyspark.sql import Window as W

    lines = w.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    o, name = W.partitionBy("l_orderkey"), lambda c: F.concat(F.lit("e"), c.cast("string"))
    after = F.coalesce(F.lead("l_linenumber").over(o.orderBy("l_linenumber")), F.when(F.col("flag") == "R", F.min("l_linenumber").over(o)))
    e = lines.withColumn("after", after).where("after <> l_linenumber")
    even = F.col("l_linenumber") % 2 == 0
    e = e.select("l_orderkey", F.when(even, name(F.col("after"))).otherwise(name(F.col("l_linenumber"))).alias("event_1"), F.when(even, name(F.col("l_linenumber"))).otherwise(name(F.col("after"))).alias("event_2"), F.when(even, "after").otherwise("BEFORE").alias("relation"))
    return rules.temporal_cycles(e, lines.select("l_orderkey", name(F.col("l_linenumber")).alias("event_id")), ["l_orderkey"]).select("l_orderkey", F.array_join("cycle", ">").alias("cycle"))


_AGE = ", aged AS (SELECT *, CASE WHEN floor(value) BETWEEN 0 AND 150 THEN CAST(floor(value) AS INTEGER) END AS age, row_number() OVER (PARTITION BY entity_id, property_name ORDER BY created_at, version_id) AS place FROM fact_version)"
_STATE = ", st AS (SELECT *, CASE WHEN value < 10 THEN 'DEAD' WHEN value > 90 THEN 'ALIVE' END AS state, row_number() OVER (PARTITION BY entity_id, property_name ORDER BY created_at, version_id) AS place FROM fact_version)"


def _near(table: str, cond_new: str, cond_old: str, side: str) -> str:
    sign, pick = ("<", "arg_max") if side == "before" else (">", "arg_min")
    return f"""SELECT n.entity_id, n.property_name, n.version_id, {pick}(o, (o.chapter_number, o.place)) AS o, any_value(n) AS n
        FROM {table} n JOIN {table} o ON o.entity_id = n.entity_id AND o.property_name = n.property_name AND o.chapter_number {sign} n.chapter_number
            AND o.status IN ('ACTIVE', 'SUPERSEDED') AND {cond_old} WHERE {cond_new} GROUP BY ALL"""


_LAST = "last_value(CASE WHEN status = 'ACTIVE' THEN {x} END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY created_at, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_IMMUTABLE = f""", judged AS (SELECT *, {_LAST.format(x='version_id', k='entity_id, property_name')} AS ref, {_LAST.format(x='floor(value)', k='entity_id, property_name')} AS ref_value
    FROM fact_version WHERE property_name IN ('signup', 'error')), found AS (SELECT entity_id, property_name, ref AS old_version_id, version_id AS new_version_id FROM judged WHERE ref IS NOT NULL AND ref_value <> floor(value))"""

QUERIES = {
    "asof_fact_slice": (lambda w: fact_slice(w).select("version_id", *FACT, "value", "chapter_number", "status"), with_views(_EXCLUDED + _SLICE + " SELECT version_id, entity_id, property_name, value, chapter_number, status FROM fact_slice", "fact_version", "contradiction")),
    "asof_edge_slice": (lambda w: edge_slice(w).select("version_id", *PAIR, "relationship_type", "chapter_number", "status"), with_views(_EDGE_SLICE + " SELECT version_id, source_id, target_id, relationship_type, chapter_number, status FROM edge_slice", "relationship_version")),
    "current_active": (
        lambda w: ver.current_active(w.fact_version(), FACT).select("version_id", *FACT, "value"),
        with_views("SELECT version_id, entity_id, property_name, value FROM fact_version WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY entity_id, property_name ORDER BY created_at DESC, version_id DESC) = 1", "fact_version"),
    ),
    "current_or_latest": (
        lambda w: ver.current_or_latest(w.relationship_version(), PAIR).select("version_id", *PAIR, "status", "relationship_type"),
        with_views("SELECT version_id, source_id, target_id, status, relationship_type FROM relationship_version QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY (status = 'ACTIVE') DESC, created_at DESC, version_id DESC) = 1", "relationship_version"),
    ),
    "latest_if_active": (
        lambda w: ver.latest_if_active(w.fact_version(), FACT).select("version_id", *FACT, "value"),
        with_views("SELECT version_id, entity_id, property_name, value FROM (SELECT * FROM fact_version QUALIFY row_number() OVER (PARTITION BY entity_id, property_name ORDER BY created_at DESC, version_id DESC) = 1) WHERE status = 'ACTIVE'", "fact_version"),
    ),
    "chat_values": (
        lambda w: ver.current_active(w.fact_version(), FACT).where(~S.is_blank(F.col("value").cast("string"))).select(*FACT, "value"),
        with_views("SELECT entity_id, property_name, value FROM (SELECT * FROM fact_version WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY entity_id, property_name ORDER BY created_at DESC, version_id DESC) = 1) WHERE value IS NOT NULL", "fact_version"),
    ),
    "fact_history": (
        lambda w: ver.history(w.fact_version(), FACT).select("version_id", F.col("place").cast("long").alias("place"), "previous_id", "next_id"),
        with_views("SELECT version_id, row_number() OVER h - 1 AS place, lag(version_id) OVER h AS previous_id, lead(version_id) OVER h AS next_id FROM fact_version WINDOW h AS (PARTITION BY entity_id, property_name ORDER BY created_at, version_id)", "fact_version"),
    ),
    "last_active_reference": (
        lambda w: ver.last_active_before(w.relationship_version(), PAIR, F.col("relationship_type")).select("version_id", "reference_id", F.col("reference_value").alias("reference_type")),
        with_views(f"SELECT version_id, {_LAST.format(x='version_id', k='source_id, target_id')} AS reference_id, {_LAST.format(x='relationship_type', k='source_id, target_id')} AS reference_type FROM relationship_version", "relationship_version"),
    ),
    "statuses_after_writes": (
        lambda w: ver.statuses_after_writes(w.relationship_version(), PAIR, "relationship_type", F.col("status") == "CONTRADICTED").select("version_id", "stored"),
        with_views(""", a AS (SELECT *, status = 'CONTRADICTED' AS bad FROM relationship_version),
            b AS (SELECT *, last_value(CASE WHEN NOT bad THEN relationship_type END IGNORE NULLS) OVER (PARTITION BY source_id, target_id ORDER BY created_at, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
            c AS (SELECT *, sum(CASE WHEN NOT bad AND prev IS DISTINCT FROM relationship_type THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, target_id ORDER BY created_at, version_id) AS run FROM b)
            SELECT version_id, CASE WHEN bad THEN 'CONTRADICTED' WHEN run = max(run) OVER (PARTITION BY source_id, target_id) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS stored FROM c""", "relationship_version"),
    ),
    "rule_immutable": (lambda w: immutable(w).select(*FACT, "old_version_id", "new_version_id"), with_views(_IMMUTABLE + " SELECT * FROM found", "fact_version")),
    "rule_age": (
        lambda w: rules.age_monotonic(w.fact_version(), FACT, age(w)).select(*FACT, "old_version_id", "new_version_id"),
        with_views(_AGE + f""", b AS ({_near('aged', 'n.age IS NOT NULL', 'o.age IS NOT NULL', 'before')}), a AS ({_near('aged', 'n.age IS NOT NULL', 'o.age IS NOT NULL', 'after')})
            SELECT entity_id, property_name, o.version_id AS old_version_id, version_id AS new_version_id FROM b WHERE n.age < o.age
            UNION ALL SELECT entity_id, property_name, o.version_id, version_id FROM a WHERE n.age > o.age""", "fact_version"),
    ),
    "rule_dead_alive": (
        lambda w: rules.dead_then_alive(w.fact_version(), FACT, state()).select(*FACT, "old_version_id", "new_version_id"),
        with_views(_STATE + f""", b AS ({_near('st', "n.state = 'ALIVE'", "o.state = 'DEAD'", 'before')}), a AS ({_near('st', "n.state = 'DEAD'", "o.state = 'ALIVE'", 'after')})
            SELECT entity_id, property_name, o.version_id AS old_version_id, version_id AS new_version_id FROM b UNION ALL SELECT entity_id, property_name, o.version_id, version_id FROM a""", "fact_version"),
    ),
    "rule_incompatible": (
        lambda w: rules.incompatible(w.relationship_version(), PAIR).select(*PAIR, "old_version_id", "new_version_id"),
        with_views(f""", j AS (SELECT *, {_LAST.format(x='version_id', k='source_id, target_id')} AS ref, {_LAST.format(x='relationship_type', k='source_id, target_id')} AS kind FROM relationship_version)
            SELECT source_id, target_id, ref AS old_version_id, version_id AS new_version_id FROM j WHERE (least(kind, relationship_type), greatest(kind, relationship_type)) IN (('ENEMY_OF', 'FRIEND_OF'), ('ENEMY_OF', 'MARRIED_TO'), ('ALLY_OF', 'DEAD_AT_HANDS_OF'))""", "relationship_version"),
    ),
    "rule_single_source": (
        lambda w: rules.single_source(w.relationship_version(), PAIR).select(*PAIR, "old_version_id", "new_version_id"),
        with_views(""", f AS (SELECT * FROM relationship_version WHERE relationship_type = 'FATHER_OF')
            SELECT n.source_id, n.target_id, arg_max(o.version_id, (o.created_at, o.version_id)) AS old_version_id, n.version_id AS new_version_id
            FROM f n JOIN f o ON o.target_id = n.target_id AND o.source_id <> n.source_id AND o.status = 'ACTIVE' AND (o.created_at, o.version_id) < (n.created_at, n.version_id)
            GROUP BY n.source_id, n.target_id, n.version_id""", "relationship_version"),
    ),
    "rule_temporal_cycles": (
        cycles,
        """WITH l AS (SELECT l_orderkey, l_linenumber AS k, max(l_returnflag) AS f FROM lineitem GROUP BY ALL)
            SELECT l_orderkey, string_agg('e' || k, '>' ORDER BY k) AS cycle FROM l GROUP BY 1 HAVING count(*) > 1 AND arg_max(f, k) = 'R'""",
    ),
    "contradiction_dedupe": (new_findings, with_views(_IMMUTABLE + " SELECT old_version_id, new_version_id FROM found f WHERE NOT EXISTS (SELECT 1 FROM contradiction c WHERE c.old_fact_version_id = f.old_version_id AND c.new_fact_version_id = f.new_version_id)", "fact_version", "contradiction")),
    "decided_claims": (
        decided,
        with_views("""SELECT DISTINCT n.entity_id, n.property_name, least(CAST(CAST(floor(o.value) AS BIGINT) AS VARCHAR), CAST(CAST(floor(n.value) AS BIGINT) AS VARCHAR)) AS a, greatest(CAST(CAST(floor(o.value) AS BIGINT) AS VARCHAR), CAST(CAST(floor(n.value) AS BIGINT) AS VARCHAR)) AS b
            FROM contradiction c JOIN fact_version o ON o.version_id = c.old_fact_version_id JOIN fact_version n ON n.version_id = c.new_fact_version_id WHERE c.status <> 'DETECTED'""", "fact_version", "contradiction"),
    ),
    "resolution_statuses": (
        resolved,
        with_views(""", m AS (SELECT id, min(s) AS s FROM (SELECT new_fact_version_id AS id, 'ACTIVE' AS s FROM contradiction WHERE status = 'RESOLVED' UNION ALL SELECT old_fact_version_id, 'SUPERSEDED' FROM contradiction WHERE status = 'RESOLVED') GROUP BY id)
            SELECT coalesce(m.s, f.status) AS status, count(*) AS n FROM fact_version f LEFT JOIN m ON m.id = f.version_id GROUP BY 1""", "fact_version", "contradiction"),
    ),
    "graph_edges_latest": (
        lambda w: graph.edges_latest(pairs(w), w.relationship_version()),
        with_views(""", now AS (SELECT * FROM relationship_version WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY created_at DESC, version_id DESC) = 1)
            SELECT p.source_id, p.target_id, coalesce(n.relationship_type, 'RELATED_TO') AS relationship_type, n.chapter_number FROM (SELECT DISTINCT source_id, target_id FROM relationship_version) p LEFT JOIN now n USING (source_id, target_id)""", "relationship_version"),
    ),
    "node_degree": (
        lambda w: graph.degrees(pairs(w)),
        with_views("SELECT id, count(*) AS degree FROM (SELECT unnest([source_id, target_id]) AS id FROM (SELECT DISTINCT source_id, target_id FROM relationship_version)) GROUP BY id", "relationship_version"),
    ),
    "graph_nodes_asof": (
        nodes_asof,
        with_views(_EXCLUDED + _SLICE + _EDGE_SLICE + """, deg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source_id, target_id]) AS id FROM edge_slice) GROUP BY id),
            known AS (SELECT entity_id AS id, count(*) AS n_facts FROM fact_slice GROUP BY 1),
            seen AS (SELECT DISTINCT entity_id AS id FROM mention WHERE chapter_number <= 10),
            tagged AS (SELECT entity_id AS id FROM fact_version WHERE chapter_number IS NOT NULL UNION SELECT source_id FROM relationship_version WHERE chapter_number IS NOT NULL UNION SELECT target_id FROM relationship_version WHERE chapter_number IS NOT NULL
                UNION SELECT entity_id FROM mention UNION SELECT p.entity_id FROM participant p JOIN event e USING (event_id) WHERE e.chapter_number IS NOT NULL)
            SELECT e.id, e.canonical_name, e.entity_type, coalesce(degree, 0) AS degree, coalesce(n_facts, 0) AS n_facts FROM entity e LEFT JOIN deg USING (id) LEFT JOIN known USING (id)
            WHERE (degree IS NOT NULL OR n_facts IS NOT NULL OR e.id IN (SELECT id FROM seen) OR e.id NOT IN (SELECT id FROM tagged))""", "fact_version", "contradiction", "relationship_version", "mention", "participant", "event", "entity"),
    ),
    "timeline_order": (
        lambda w: graph.timeline(w.event(), "world_id").select("event_id", "world_id", F.col("place").cast("long").alias("place")),
        with_views("SELECT event_id, world_id, row_number() OVER (PARTITION BY world_id ORDER BY chapter_number ASC NULLS FIRST, sequence_index ASC NULLS LAST, start_position ASC NULLS LAST, created_at ASC NULLS FIRST, event_id) AS place FROM event", "event"),
    ),
    "recent_events_topk": (
        lambda w: graph.recent_events(w.event(), 25).select("event_id", "chapter_number", "sequence_index"),
        with_views("SELECT event_id, chapter_number, sequence_index FROM event ORDER BY chapter_number DESC NULLS LAST, sequence_index DESC NULLS LAST, created_at DESC NULLS LAST, event_id DESC LIMIT 25", "event"),
    ),
    "appearances": (
        appearances,
        with_views(""", every AS (SELECT p.entity_id, e.chapter_number, 0 AS r, 'Event: ' || arg_max(e.event_type, e.event_id) AS reason FROM participant p JOIN event e USING (event_id) GROUP BY 1, 2 UNION ALL SELECT entity_id, chapter_number, 1, 'fact' FROM fact_version
            UNION ALL SELECT unnest([source_id, target_id]), chapter_number, 2, 'relationship' FROM relationship_version UNION ALL SELECT entity_id, chapter_number, 3, 'mention' FROM mention)
            SELECT entity_id, chapter_number, arg_min(reason, r) AS reason FROM every WHERE chapter_number IS NOT NULL GROUP BY ALL""", "participant", "event", "fact_version", "relationship_version", "mention"),
    ),
    "co_stars": (
        lambda w: graph.co_stars(w.participations()),
        with_views(", p AS (SELECT DISTINCT event_id, entity_id FROM participant) SELECT a.entity_id, b.entity_id AS other_id, count(*) AS n_events FROM p a JOIN p b USING (event_id) WHERE a.entity_id <> b.entity_id GROUP BY ALL", "participant"),
    ),
    "relations_either_end": (
        lambda w: graph.relations_of(w.relationship_version(), w.entity().where("entity_type = 'building'").select("id")).select("version_id", *PAIR),
        with_views("SELECT version_id, source_id, target_id FROM relationship_version WHERE source_id IN (SELECT id FROM entity WHERE entity_type = 'building') OR target_id IN (SELECT id FROM entity WHERE entity_type = 'building')", "relationship_version", "entity"),
    ),
    "chapter_steps": (
        lambda w: graph.chapter_steps(w.event(), "world_id"),
        with_views("SELECT world_id, chapter_number, lag(chapter_number) OVER o AS previous, lead(chapter_number) OVER o AS next FROM (SELECT DISTINCT world_id, chapter_number FROM event WHERE chapter_number IS NOT NULL) WINDOW o AS (PARTITION BY world_id ORDER BY chapter_number)", "event"),
    ),
}
