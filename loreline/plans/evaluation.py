"""Scoring queries: labels are gold, a length rule is the prediction; word spans of documents are spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import evaluate as ev
from loreline.operators import scoring, spans
from loreline.sources.worlds import World, with_views


def gold(w: World):
    return w.raw("labels").where("quality = 1").join(w.raw("documents").select("doc_id", "lang"), "doc_id").select("lang", "doc_id")


def pred(w: World):
    return w.raw("labels").select("doc_id").join(w.raw("documents").select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars BETWEEN 500 AND 4000").select("lang", "doc_id")


def counts(w: World):
    return ev.set_counts(pred(w), gold(w), ["lang"], ["doc_id"])


def micro(w: World):
    c = counts(w).withColumn("coverage", F.when(F.col("lang") == "en", "exhaustive").when(F.col("lang") == "fr", "partial").otherwise("none"))
    return ev.micro_covered(c.withColumn("layer", F.when(F.col("lang").isin("en", "fr"), "a").otherwise("b")), "layer")


def clusters(w: World):
    o = w.raw("orders")
    base = o.select((F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 10).alias("p"), (F.col("o_custkey") % 12).alias("g"))
    return base.select("doc", "item", F.col("p").alias("cluster")), base.select("doc", "item", F.col("g").alias("cluster"))


def gold_spans(w: World):
    """Made of lineitem: the document is the order, a span starts by part and is as long as its line number says."""
    return w.raw("lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_linenumber") * 4).alias("end")).distinct()


def pred_spans(w: World):
    return w.raw("lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 60).alias("start"), (F.col("l_suppkey") % 60 + F.col("l_linenumber") * 2).alias("end")).distinct()


_SPANS = """WITH g AS (SELECT DISTINCT l_orderkey AS doc, l_partkey * 10 + l_linenumber AS id, l_partkey % 60 AS s, l_partkey % 60 + l_linenumber * 4 AS e FROM lineitem WHERE l_linenumber <= 3),
    p AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey * 10 + l_linenumber AS id, l_suppkey % 60 AS s, l_suppkey % 60 + l_linenumber * 2 AS e FROM lineitem WHERE l_linenumber > 3)"""


def overlaps(w: World):
    return spans.overlapping(pred_spans(w), gold_spans(w), ["doc"], 16).select("doc", F.col("l.id").alias("pred_id"), F.col("r.id").alias("gold_id"), "overlap")


def contained(w: World):
    return spans.containing(gold_spans(w), pred_spans(w), ["doc"], "id").select("doc", "id", F.col("r.start").alias("start"), F.col("r.end").alias("end")).distinct()


def zoned_spans(w: World):
    zone = F.when(F.col("id") % 10 == 3, "ignored").otherwise("gold")
    return gold_spans(w).withColumns({"type": F.lit("character"), "zone": zone})


def scopes(w: World):
    coverage = F.when(F.col("o_orderstatus") == "F", "exhaustive").when(F.col("o_orderstatus") == "O", "partial").otherwise("none")
    return w.raw("orders").select(F.col("o_orderkey").alias("doc"), coverage.alias("coverage"), F.lit(None).cast("long").alias("region_start"), F.lit(None).cast("long").alias("region_end"))


def exact_scores(w: World):
    return scoring.exact_counts(pred_spans(w).withColumn("type", F.lit("character")), zoned_spans(w), scopes(w)).drop("metric")


def contained_ones(w: World):
    m = pred_spans(w).withColumns({"entity": F.lit(None).cast("long"), "source": F.lit("unresolved")})
    g = gold_spans(w).select("doc", "start", "end", F.col("id").alias("entity"))
    return scoring.contained_entities(m, g).where("source = 'containment'").select("doc", "id", "entity")


def points(w: World):
    p = gold_spans(w).select("doc", "id", F.col("start").alias("at"))
    return spans.at_points(p, pred_spans(w), ["doc"], "at").select("doc", F.col("l.id").alias("id"), F.col("r.id").alias("span_id"))


def aligned_counts(w: World):
    """Overlap metric of the alignment: tp, fp, fn over all documents."""
    a = spans.align(pred_spans(w), gold_spans(w), ["doc"])
    n = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    both = n(a, "tp").join(n(pred_spans(w), "n_pred"), "_k").join(n(gold_spans(w), "n_gold"), "_k")
    return both.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"))


def votes(w: World):
    return ev.majority(w.fact_version().select("entity_id", "property_name"), ["entity_id"], "property_name")


def common(w: World):
    return ev.most_common(w.fact_version(), ["entity_id"], "property_name", "version_id")


def accuracies(w: World):
    rows = w.raw("labels").join(w.raw("documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", ((F.col("n_chars") > 300) == (F.col("quality") == 1)).alias("correct"))
    return ev.accuracy(rows, "lang")


def relation_rows(w: World, part: int):
    r = w.relationship_version().where(F.col("version_id") % 2 == part)
    kind = F.when(F.col("version_id") % 7 == part, "CHILD_OF").when(F.col("version_id") % 7 == 2, "MOTHER_OF").otherwise(F.col("relationship_type"))
    end = F.when(F.col("version_id") % 13 != 0, F.col("source_id")) if part == 0 else F.col("source_id")
    return r.select(F.col("version_id").alias("id"), end.alias("source"), kind.alias("predicate"), F.col("target_id").alias("target"))


def classes(w: World):
    return ev.claim_classes(relation_rows(w, 0), relation_rows(w, 1))


_RELS = """, r AS (SELECT version_id AS id, version_id % 2 AS part, CASE WHEN version_id % 2 = 0 AND version_id % 13 = 0 THEN NULL ELSE source_id END AS a,
        CASE WHEN version_id % 7 = version_id % 2 THEN 'CHILD_OF' WHEN version_id % 7 = 2 THEN 'MOTHER_OF' ELSE relationship_type END AS k, target_id AS b FROM relationship_version),
    c AS (SELECT id, part, a AS a0, b AS b0, CASE WHEN k = 'CHILD_OF' OR (k IN ('ALLY_OF','ENEMY_OF','FRIEND_OF','MARRIED_TO') AND b < a) THEN b ELSE a END AS s, CASE WHEN k = 'CHILD_OF' THEN 'PARENT_OF' ELSE k END AS p,
        CASE WHEN k = 'CHILD_OF' OR (k IN ('ALLY_OF','ENEMY_OF','FRIEND_OF','MARRIED_TO') AND b < a) THEN a ELSE b END AS t FROM r),
    l AS (SELECT *, CASE WHEN p IN ('FATHER_OF', 'MOTHER_OF') THEN 'PARENT_OF' ELSE p END AS lp FROM c)"""


def dangling(w: World):
    return ev.dangling(w.mention(), "entity_id", w.entity().where("entity_type <> 'household'"), "id").select("mention_id", "entity_id")


def duplicates(w: World):
    return ev.repeated(w.raw("lineitem"), ["l_orderkey", "l_linenumber"])


def matched(w: World):
    names = w.raw("part").select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("p_name"))
    return ev.unique_match(names, w.raw("part").select("p_name", F.col("p_partkey").alias("key")), "p_name", "key").select("mention_id", "key", "source")


def span_checks(w: World):
    d = w.raw("documents").select("doc_id", "text", (F.col("doc_id") % 40).cast("int").alias("s"))
    end = F.col("s") + F.lit(5)
    surface = F.when(F.col("doc_id") % 3 == 0, F.lit("wrong")).otherwise(F.substring("text", F.col("s") + 1, F.lit(5)))
    return d.select("doc_id", S.span_problem(F.col("text"), F.col("s"), end, surface).alias("problem"), S.trimmed_span(F.col("text"), F.col("s"), end)["start"].cast("long").alias("trimmed_start"))


QUERIES = {
    "set_metrics_prf": (
        lambda w: ev.with_rates(counts(w)),
        """WITH g AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), p AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars BETWEEN 500 AND 4000),
            c AS (SELECT coalesce(p.lang, g.lang) AS lang, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g ON p.lang = g.lang AND p.doc_id = g.doc_id GROUP BY 1),
            r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
            SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r""",
    ),
    "micro_average": (
        lambda w: ev.micro_average(counts(w)).select("tp", "fp", "fn", F.floor(F.col("f1") * 10000).alias("f1_e4")),
        """WITH g AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), p AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars BETWEEN 500 AND 4000),
            c AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g ON p.lang = g.lang AND p.doc_id = g.doc_id)
            SELECT tp, fp, fn, CAST(floor(20000 * tp / (2 * tp + fp + fn)) AS BIGINT) AS f1_e4 FROM c""",
    ),
    "micro_average_coverage": (
        lambda w: micro(w).select("layer", "coverage", "tp", "p_tp", "fp", "fn"),
        """WITH g AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1), p AS (SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE n_chars BETWEEN 500 AND 4000),
            c AS (SELECT coalesce(p.lang, g.lang) AS lang, count(*) FILTER (p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN g ON p.lang = g.lang AND p.doc_id = g.doc_id GROUP BY 1)
            SELECT CASE WHEN lang IN ('en', 'fr') THEN 'a' ELSE 'b' END AS layer, CASE WHEN bool_or(lang IN ('en', 'fr')) THEN 'mixed' ELSE 'none' END AS coverage, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(CASE WHEN lang = 'en' THEN tp ELSE 0 END) AS BIGINT) AS p_tp, CAST(sum(CASE WHEN lang = 'en' THEN fp ELSE 0 END) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY 1""",
    ),
    "b_cubed": (
        lambda w: ev.b_cubed(*clusters(w), ["doc"]).select("doc", "p_den", "r_den", F.floor(F.col("p_num") * 1000 + 0.5).alias("p_num_e3"), F.floor(F.col("r_num") * 1000 + 0.5).alias("r_num_e3")),
        """WITH b AS (SELECT o_orderkey % 50 AS doc, o_orderkey AS item, o_custkey % 10 AS p, o_custkey % 12 AS g FROM orders),
            n AS (SELECT doc, p, g, count(*) AS n FROM b GROUP BY ALL), sp AS (SELECT doc, p, count(*) AS s FROM b GROUP BY ALL), sg AS (SELECT doc, g, count(*) AS s FROM b GROUP BY ALL), d AS (SELECT doc, count(*) AS den FROM b GROUP BY 1)
            SELECT doc, any_value(den) AS p_den, any_value(den) AS r_den, CAST(floor(sum(n * n / sp.s) * 1000 + 0.5) AS BIGINT) AS p_num_e3, CAST(floor(sum(n * n / sg.s) * 1000 + 0.5) AS BIGINT) AS r_num_e3 FROM n JOIN sp USING (doc, p) JOIN sg USING (doc, g) JOIN d USING (doc) GROUP BY doc""",
    ),
    "span_overlap_pairs": (overlaps, _SPANS + " SELECT p.doc, p.id AS pred_id, g.id AS gold_id, least(p.e, g.e) - greatest(p.s, g.s) AS overlap FROM p JOIN g ON p.doc = g.doc AND p.s < g.e AND g.s < p.e"),
    "span_containment": (contained, _SPANS + " SELECT DISTINCT g.doc, g.id, arg_min(p.s, (p.e - p.s, p.s)) AS start, arg_min(p.e, (p.e - p.s, p.s)) AS \"end\" FROM p JOIN g ON p.doc = g.doc AND p.s <= g.s AND g.e <= p.e GROUP BY g.doc, g.id"),
    "points_in_spans": (points, _SPANS + " SELECT g.doc, g.id, p.id AS span_id FROM p JOIN g ON p.doc = g.doc AND p.s <= g.s AND g.s < p.e"),
    "span_alignment": (aligned_counts, None),
    "exact_span_scores": (
        exact_scores,
        _SPANS + """, sc AS (SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'exhaustive' WHEN 'O' THEN 'partial' ELSE 'none' END AS coverage FROM orders),
            gi AS (SELECT g.*, id % 10 = 3 AS ignored FROM g JOIN sc USING (doc) WHERE coverage <> 'none'), k AS (SELECT DISTINCT doc, s, e FROM gi WHERE NOT ignored),
            z AS (SELECT doc, s, e FROM gi WHERE ignored EXCEPT SELECT doc, s, e FROM k), c AS (SELECT doc, s, e, count(*) AS n FROM p JOIN sc USING (doc) WHERE coverage <> 'none' GROUP BY ALL),
            x AS (SELECT c.doc, c.n, k.s IS NOT NULL AS hit, z.s IS NOT NULL AS ign FROM c LEFT JOIN k ON k.doc = c.doc AND k.s = c.s AND k.e = c.e LEFT JOIN z ON z.doc = c.doc AND z.s = c.s AND z.e = c.e),
            y AS (SELECT doc, count(*) FILTER (hit) AS tp, sum(CASE WHEN ign THEN 0 WHEN hit THEN n - 1 ELSE n END) AS fp FROM x GROUP BY 1), h AS (SELECT doc, count(*) AS gold FROM k GROUP BY 1)
            SELECT doc, coverage, coalesce(tp, 0) AS tp, CAST(CASE WHEN coverage = 'exhaustive' THEN coalesce(fp, 0) ELSE 0 END AS BIGINT) AS fp, coalesce(gold, 0) - coalesce(tp, 0) AS fn FROM sc LEFT JOIN y USING (doc) LEFT JOIN h USING (doc)""",
    ),
    "contained_entities": (
        contained_ones,
        _SPANS + " SELECT p.doc, p.id, arg_min(g.id, (g.e - g.s, g.id)) AS entity FROM p JOIN g ON p.doc = g.doc AND g.s <= p.s AND p.e <= g.e AND (g.s <> p.s OR g.e <> p.e) GROUP BY ALL",
    ),
    "majority_vote": (
        votes,
        with_views(", c AS (SELECT entity_id, property_name, count(*) AS n FROM fact_version GROUP BY ALL), t AS (SELECT * FROM c QUALIFY n = max(n) OVER (PARTITION BY entity_id)) SELECT entity_id, CASE WHEN count(*) = 1 THEN max(property_name) END AS property_name, max(n) AS n FROM t GROUP BY 1", "fact_version"),
    ),
    "most_common_name": (
        common,
        with_views(", c AS (SELECT entity_id, property_name, count(*) AS n, min(version_id) AS f FROM fact_version GROUP BY ALL) SELECT entity_id, property_name FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, length(property_name), f) = 1", "fact_version"),
    ),
    "accuracies": (accuracies, "SELECT lang, count(*) FILTER ((n_chars > 300) = (quality = 1)) AS correct, count(*) AS total, count(*) FILTER ((n_chars > 300) = (quality = 1)) / count(*) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1"),
    "error_classes": (
        classes,
        with_views(_RELS + """, g AS (SELECT * FROM l WHERE part = 1), p AS (SELECT * FROM l WHERE part = 0)
            SELECT id, CASE WHEN a0 IS NULL OR b0 IS NULL THEN 'unresolved' WHEN EXISTS (SELECT 1 FROM g WHERE g.s = p.s AND g.p = p.p AND g.t = p.t) THEN 'tp'
                WHEN EXISTS (SELECT 1 FROM g WHERE g.s = p.s AND g.lp = p.lp AND g.t = p.t) THEN 'lenient_only' WHEN EXISTS (SELECT 1 FROM g WHERE least(g.s, g.t) = least(p.s, p.t) AND greatest(g.s, g.t) = greatest(p.s, p.t)) THEN 'wrong_predicate'
                WHEN EXISTS (SELECT 1 FROM g WHERE g.lp = p.lp AND (g.s IN (p.s, p.t) OR g.t IN (p.s, p.t))) THEN 'wrong_endpoint' ELSE 'false_positive' END AS class FROM p""", "relationship_version"),
    ),
    "referential_errors": (dangling, with_views("SELECT mention_id, entity_id FROM mention WHERE entity_id NOT IN (SELECT id FROM entity WHERE entity_type <> 'household')", "mention", "entity")),
    "duplicate_ids": (duplicates, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "unique_name_match": (
        matched,
        "WITH k AS (SELECT lower(p_name) AS f, count(*) AS n, min(p_partkey) AS key FROM part GROUP BY 1) SELECT p_partkey AS mention_id, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous_name' ELSE 'unresolved' END AS source FROM part LEFT JOIN k ON f = lower(p_name)",
    ),
    "span_checks": (span_checks, None),
}
