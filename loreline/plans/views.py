"""Searches, windows, limits, job writes, ledger and integration over the world tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import answers as A
from loreline.operators import integrate, ledger, views, writes
from loreline.plans.tables import _RUNS, runs
from loreline.sources.worlds import World, with_views


def visible(w: World):
    return views.visible_graph(w.entity(), w.relationship_version(), ["building", "machinery"], "mer#00000000")


def typed_events(w: World):
    return w.event().withColumn("event_type", F.when(F.col("event_type") == "5-low", "Other").otherwise(F.col("event_type")))


def reviewed(w: World):
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return views.by_review(w.raw("orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


def windows(w: World):
    return views.pair_windows(w.raw("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 5).alias("entity"), F.col("l_linenumber").cast("long").alias("sentence")))


def requests(w: World):
    e = w.raw("events")
    rows = e.select("event_type", F.col("user_id").alias("prompt_tokens"), F.length("props").cast("long").alias("output_tokens"), F.floor("value").alias("seconds"), (F.col("value") > 90).alias("cut_off"), F.when(F.col("value") > 10, "x").alias("answer"))
    return views.request_totals(rows, ["event_type"])


def pairs_made(w: World):
    v = w.relationship_version()
    stored = v.where("status = 'ACTIVE'").select("source_id", "target_id").distinct().withColumn("id", integrate.ident(F.col("source_id"), F.col("target_id")))
    return writes.get_or_create(stored, v, ["source_id", "target_id"], integrate.ident(F.col("source_id"), F.col("target_id"))).groupBy("source_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def broke_off(w: World):
    return writes.fail_pending(runs(w), 7, "stopped").groupBy("job_id", "status").agg(F.count("*").alias("n"), F.count_if(F.col("error") == "stopped").alias("stopped"))


def values_checked(w: World):
    k = F.col("p_partkey") % 4
    prop = F.when(k == 0, "title").when(k == 1, "age").when(k == 2, "origin").otherwise("birth_place")
    value = F.when(k == 0, F.when(F.col("p_size") > 25, "Lady").otherwise(F.col("p_brand"))).when(k == 1, F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("a child")).when(k == 2, F.lower("p_name")).otherwise(F.concat(F.when(F.col("p_size") > 25, "the ").otherwise("some "), F.lower("p_name")))
    rows = w.raw("part").select("p_partkey", prop.alias("prop"), value.alias("value"))
    return rows.select("p_partkey", A.plausible(F.col("prop"), F.col("value")).alias("plausible"))


def reopened(w: World):
    c = w.contradiction()
    return ledger.with_status(c, c.where("status = 'DISMISSED'").select("id", F.lit("DETECTED").alias("status"))).select("id", "status")


def signed(w: World):
    c = w.contradiction()
    nothing = {n: F.lit(None).cast("long") for n in ("old_relationship_version_id", "new_relationship_version_id", "event_id_a", "event_id_b")}
    return ledger.signatures(c.withColumns(nothing), w.fact_version(), w.relationship_version(), w.event().withColumn("description", F.lit(""))).select("id", F.col("signature").isNotNull().alias("signed"))


def integrated(w: World):
    """Three chapters, each of which gives every nation an age and a colour of eyes."""
    n, state = w.raw("nation"), integrate.empty_state(w.spark)
    nothing = w.spark.createDataFrame([], "place int, subject string, predicate string, object string")
    silent = w.spark.createDataFrame([], "type string, description string")
    for c in (1, 2, 3):
        k = F.col("n_nationkey")
        colour = F.element_at(F.array(F.lit("grey"), F.lit("green"), F.lit("brown")), ((k * c) % 3 + 1).cast("int"))
        told = F.create_map(F.lit("age"), ((k * 7 + 13 * c) % 50 + 10).cast("string"), F.lit("eye_color"), colour)
        people = n.select(k.cast("int").alias("place"), F.initcap("n_name").alias("name"), F.lit("location").alias("type"), F.array().cast("array<string>").alias("aliases"), told.alias("attributes"))
        state = integrate.integrate_chapter(state, c, people, nothing, silent)
    names = state.entities.select(F.col("id").alias("entity_id"), F.upper("canonical_name").alias("name"))
    return state.facts.join(names, "entity_id").select("name", "property_name", "chapter_number", "value", "status")


_INTEGRATED = """WITH n AS (SELECT n_name AS name, n_nationkey AS k FROM nation), a AS (SELECT *, (k * 7 + 13) % 50 + 10 AS a1, (k * 7 + 26) % 50 + 10 AS a2, (k * 7 + 39) % 50 + 10 AS a3 FROM n),
    b AS (SELECT *, a2 >= a1 AS ok2 FROM a), c AS (SELECT *, a3 >= CASE WHEN ok2 THEN a2 ELSE a1 END AS ok3 FROM b), e AS (SELECT name, k, unnest([1, 2, 3]) AS c FROM n)
    SELECT name, 'age' AS property_name, 1 AS chapter_number, CAST(a1 AS VARCHAR) AS value, CASE WHEN ok2 OR ok3 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM c
    UNION ALL SELECT name, 'age', 2, CAST(a2 AS VARCHAR), CASE WHEN NOT ok2 THEN 'CONTRADICTED' WHEN ok3 THEN 'SUPERSEDED' ELSE 'ACTIVE' END FROM c
    UNION ALL SELECT name, 'age', 3, CAST(a3 AS VARCHAR), CASE WHEN ok3 THEN 'ACTIVE' ELSE 'CONTRADICTED' END FROM c
    UNION ALL SELECT name, 'eye_color', c, ['grey', 'green', 'brown'][(k * c) % 3 + 1], CASE WHEN (k * c) % 3 = k % 3 THEN 'ACTIVE' ELSE 'CONTRADICTED' END FROM e"""

_VISIBLE = ", v AS (SELECT id FROM entity WHERE entity_type IN ('building', 'machinery') AND (contains(lower(canonical_name), 'mer#00000000') OR contains(entity_type, 'mer#00000000')))"

QUERIES = {
    "integrate_chapters": (integrated, _INTEGRATED),
    "visible_nodes": (lambda w: visible(w)[0].select("id"), with_views(_VISIBLE + " SELECT id FROM v", "entity")),
    "visible_edges": (lambda w: visible(w)[1].select("version_id"), with_views(_VISIBLE + " SELECT version_id FROM relationship_version WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)", "entity", "relationship_version")),
    "graph_neighbours": (
        lambda w: views.neighbours(w.relationship_version(), w.entity().where("entity_type = 'furniture'")),
        with_views(", f AS (SELECT id FROM entity WHERE entity_type = 'furniture') SELECT source_id AS focus_id, target_id AS id FROM relationship_version WHERE source_id IN (SELECT id FROM f) UNION SELECT target_id, source_id FROM relationship_version WHERE target_id IN (SELECT id FROM f) UNION SELECT id, id FROM f", "entity", "relationship_version"),
    ),
    "ledger_search": (
        lambda w: views.ledger_tab(w.entity(), "household", "R#00000001", "canonical_name", "entity_type").select("id"),
        with_views("SELECT id FROM entity WHERE entity_type = 'household' AND contains(lower(canonical_name), 'r#00000001')", "entity"),
    ),
    "names_with_prefix": (lambda w: views.with_prefix(w.entity(), "canonical_name", "Customer#0000001").select("id"), with_views("SELECT id FROM entity WHERE starts_with(canonical_name, 'Customer#0000001')", "entity")),
    "worlds_with_events": (lambda w: views.with_chapters(w.world().withColumnRenamed("id", "world_id"), w.event(), "world_id").select("world_id"), with_views("SELECT id AS world_id FROM world WHERE id IN (SELECT world_id FROM event)", "world", "event")),
    "chapters_of_a_world": (
        lambda w: views.chapters_of_world(w.chapter(), w.chapter().select("manuscript_id", (F.length("manuscript_id") % 2).alias("world_id")).distinct(), 1).select("chapter_id"),
        with_views("SELECT chapter_id FROM chapter WHERE length(manuscript_id) % 2 = 1", "chapter"),
    ),
    "told_events": (lambda w: views.told_events(typed_events(w)).select("event_id"), with_views("SELECT event_id FROM event WHERE event_type <> '5-low'", "event")),
    "gold_and_ignored": (lambda w: reviewed(w).select("id", "zone"), "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'gold' ELSE 'ignored' END AS zone FROM orders WHERE o_orderstatus IN ('F', 'O')"),
    "first_of_each": (
        lambda w: views.first_of_each(w.raw("lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("place")), ["l_orderkey", "l_suppkey"], "place"),
        "SELECT l_orderkey, l_suppkey, CAST(min(l_linenumber) AS BIGINT) AS place FROM lineitem GROUP BY ALL",
    ),
    "latest_three_facts": (
        lambda w: views.top_each(w.fact_version(), ["entity_id"], [F.col("created_at").desc(), F.col("version_id").desc()], 3).select("entity_id", "version_id", F.col("nth").cast("long").alias("nth")),
        with_views("SELECT entity_id, version_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, version_id DESC) AS nth FROM fact_version QUALIFY nth <= 3", "fact_version"),
    ),
    "pair_windows": (
        windows,
        """WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 5 AS e, CAST(l_linenumber AS BIGINT) AS s FROM lineitem),
            p AS (SELECT x.doc, x.e AS a, y.e AS b, x.s AS s, y.s AS t FROM m x JOIN m y ON x.doc = y.doc AND x.e < y.e AND y.s BETWEEN x.s - 1 AND x.s + 1),
            o AS (SELECT doc, a, b, s FROM p WHERE s = t), n AS (SELECT DISTINCT doc, a, b, least(s, t) AS f, greatest(s, t) AS l FROM p WHERE s <> t),
            w AS (SELECT doc, a, b, s AS first, s AS last FROM o UNION ALL SELECT doc, a, b, f, l FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc = n.doc AND o.a = n.a AND o.b = n.b AND (o.s = n.f OR o.s = n.l)))
            SELECT doc, a, b, first, last FROM w QUALIFY row_number() OVER (PARTITION BY doc, a, b ORDER BY first, last) <= 6""",
    ),
    "next_chapter_version": (
        lambda w: views.next_version(w.fact_version().select("entity_id", F.col("chapter_number").alias("version_number")), ["entity_id"]).select("entity_id", "next_version"),
        with_views("SELECT entity_id, greatest(count(*), coalesce(max(chapter_number), 0)) + 1 AS next_version FROM fact_version GROUP BY 1", "fact_version"),
    ),
    "request_totals": (
        requests,
        "SELECT event_type, count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(length(props)) AS BIGINT) AS output_tokens, CAST(sum(floor(value)) AS BIGINT) AS seconds, count(*) FILTER (value > 90) AS cut_off, count(*) FILTER (value <= 10 OR value IS NULL) AS unanswered FROM events GROUP BY 1",
    ),
    "pairs_get_or_create": (pairs_made, with_views("SELECT source_id, count(DISTINCT target_id) AS n, count(DISTINCT target_id) AS ids FROM relationship_version GROUP BY 1", "relationship_version")),
    "job_broke_off": (
        broke_off,
        with_views(_RUNS + ", x AS (SELECT job_id, job_id = 7 AND status = 'PENDING' AS hit, status FROM runs) SELECT job_id, CASE WHEN hit THEN 'FAILED' ELSE status END AS status, count(*) AS n, count(*) FILTER (hit) AS stopped FROM x GROUP BY 1, 2", "world"),
    ),
    "plausible_values": (
        values_checked,
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size > 25 WHEN 1 THEN p_size > 25 WHEN 2 THEN false ELSE p_size > 25 END AS plausible FROM part",
    ),
    "reopened_contradictions": (reopened, with_views("SELECT id, CASE status WHEN 'DISMISSED' THEN 'DETECTED' ELSE status END AS status FROM contradiction", "contradiction")),
    "claim_signatures": (
        signed,
        with_views("SELECT c.id, EXISTS (SELECT 1 FROM fact_version a JOIN fact_version b ON a.entity_id = b.entity_id AND a.property_name = b.property_name WHERE a.version_id = c.old_fact_version_id AND b.version_id = c.new_fact_version_id) AS signed FROM contradiction c", "contradiction", "fact_version"),
    ),
}
