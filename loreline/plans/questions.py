"""Queries on closed questions: conversations are documents, turns their sentences, four turns a chunk, first and second words whom they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.operators import closed
from loreline.plans.answers import turns
from loreline.sources.worlds import World


def parts(w: World) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns with their words, mentions, sentences and chunks."""
    x = turns(w).withColumn("part", F.floor(F.col("chunk") / 4).cast("int"))
    told = F.explode(F.array(F.struct(F.lit("proper").alias("kind"), F.col("words")[0].alias("text"), F.col("start").alias("start")), F.struct(F.lit("nominal").alias("kind"), F.col("words")[1].alias("text"), (F.col("start") + 1).alias("start")))).alias("m")
    mentions = x.select("doc", told).select("doc", F.lower("m.text").alias("entity"), "m.text", F.lit("character").alias("type"), "m.kind", "m.start")
    chunks = x.groupBy("doc", F.col("part").alias("chunk")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return x, mentions, x.select("doc", F.col("chunk").alias("sentence"), "start", "end", "text"), chunks


def values(w: World) -> DataFrame:
    """Of each turn's first word its third is answered in small letters; every fifth answer says nothing, every fifth other is made up."""
    x, mentions, sentences, chunks = parts(w)
    value = F.when(F.length("text") % 5 == 0, " Unknown. ").when(F.length("text") % 5 == 1, "no such words").otherwise(F.lower(F.col("words")[2]))
    answers = x.select("doc", F.col("part").alias("chunk"), F.lower(F.col("words")[0]).alias("entity"), F.concat(F.lit("turn "), "chunk").alias("property"), value.alias("value"))
    found = closed.checked_values(answers, closed.fact_windows(mentions, sentences, chunks))
    return found.select("doc", "property", F.when(F.col("result") == "kept", F.col("value")).alias("value"), "result", "start", "end", F.col("sentence").cast("int").alias("sentence"))


def pairs(w: World) -> DataFrame:
    _, mentions, sentences, _ = parts(w)
    return closed.pair_windows(closed.mentioned(mentions, sentences))


def attributed(w: World) -> DataFrame:
    """Third words are facts of first ones and first words relate to second ones; raw answers name one or the other, in part."""
    x, mentions, _, chunks = parts(w)
    word = lambda n: F.col("words")[n - 1]
    n = F.length("text")
    x = x.withColumns({"id": F.col("chunk"), "entity": F.lower(word(1)), "other": F.lower(word(2))})
    known = x.select("doc", "entity", F.col("entity").alias("name")).unionByName(x.select("doc", F.col("other").alias("entity"), F.col("other").alias("name"))).distinct()
    at = {"at": F.col("start")}
    facts = x.withColumns(at | {"property": F.concat(F.lit("p"), "id"), "value": word(3)}).select("doc", "id", "entity", "property", "value", "at")
    raw = x.where(n % 4 != 1).select("doc", F.col("part").alias("chunk"), F.when(n % 3 == 0, word(2)).otherwise(F.concat(F.lit("The "), word(1))).alias("name"), F.concat(F.lit("p"), "id").alias("property"), F.when(n % 4 == 2, word(4)).otherwise(F.concat(word(3), F.lit("  MORE"))).alias("value"))
    relations = x.withColumns(at | {"predicate": F.when(n % 2 == 0, "KNOWS").otherwise("FATHER_OF")}).select("doc", "id", F.col("entity").alias("subject"), "predicate", F.col("other").alias("object"), "at")
    said = x.where(n % 4 != 0).select("doc", F.col("part").alias("chunk"), F.concat(F.lit("an "), word(2)).alias("subject"), F.when(n % 4 == 1, "child_of").otherwise("knows").alias("relation"), word(1).alias("object"))
    of_facts = closed.fact_attribution(facts, raw, known, mentions, chunks).withColumn("kind", F.lit("fact"))
    return of_facts.unionByName(closed.relation_attribution(relations, said, known, mentions, chunks).withColumn("kind", F.lit("relationship"))).select("kind", "doc", "id", "raw")


_TURNS = r"""WITH x AS (SELECT conv_id AS doc, turn, trim(text) AS text, regexp_split_to_array(trim(text), '\s+') AS ws FROM conversations),
    t AS (SELECT *, turn // 4 AS part, length(text) AS n, lower(ws[1]) AS e, lower(ws[2]) AS o, sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY turn) - 1 - length(text) AS start FROM x WHERE len(ws) >= 4),
    m AS (SELECT doc, part, turn, e AS entity FROM t UNION SELECT doc, part, turn, o FROM t)"""

QUERIES = {
    "closed_answers": (
        values,
        _TURNS + r""", a AS (SELECT *, trim(ws[3], '.,;:') AS v FROM t), h AS (SELECT a.doc, a.turn, min(s.turn) AS seen FROM a JOIN m ON m.doc = a.doc AND m.part = a.part AND m.entity = a.e JOIN t AS s ON s.doc = m.doc AND s.turn = m.turn AND strpos(lower(s.text), lower(a.v)) > 0 GROUP BY ALL),
            r AS (SELECT a.*, CASE WHEN n % 5 = 0 OR lower(v) IN ('', 'none', 'null', 'n/a', 'na', 'unknown') THEN 'none' WHEN n % 5 = 1 THEN 'invalid' ELSE 'kept' END AS result FROM a)
            SELECT doc, 'turn ' || r.turn AS property, result, CASE WHEN result = 'kept' THEN s.text[strpos(lower(s.text), lower(v)):strpos(lower(s.text), lower(v)) + length(v) - 1] END AS value,
                   CASE WHEN result = 'kept' THEN s.start + strpos(lower(s.text), lower(v)) - 1 END AS start, CASE WHEN result = 'kept' THEN s.start + strpos(lower(s.text), lower(v)) - 1 + length(v) END AS "end", CASE WHEN result = 'kept' THEN h.seen END AS sentence
            FROM r JOIN h USING (doc, turn) JOIN (SELECT doc, turn AS seen, text, start FROM t) AS s USING (doc, seen)""",
    ),
    "pair_windows": (
        pairs,
        _TURNS + """, b AS (SELECT DISTINCT x.doc, x.entity AS a, y.entity AS b, x.turn AS low FROM m AS x JOIN m AS y ON y.doc = x.doc AND y.turn = x.turn AND x.entity < y.entity),
            n AS (SELECT DISTINCT x.doc, least(x.entity, y.entity) AS a, greatest(x.entity, y.entity) AS b, x.turn AS low FROM m AS x JOIN m AS y ON y.doc = x.doc AND y.turn = x.turn + 1 AND x.entity <> y.entity),
            r AS (SELECT doc, a, b, low, low AS high FROM b UNION ALL SELECT doc, a, b, low, low + 1 FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = n.doc AND b.a = n.a AND b.b = n.b AND b.low IN (n.low, n.low + 1)))
            SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, a, b ORDER BY low, high) <= 6""",
    ),
    "raw_answers": (
        attributed,
        _TURNS + """, f AS (SELECT *, CASE WHEN n % 4 = 2 THEN lower(ws[4]) ELSE lower(ws[3]) || ' more' END AS said, CASE WHEN n % 3 = 0 THEN o ELSE e END AS who FROM t),
            s AS (SELECT doc, part, o AS a, e AS b, CASE WHEN n % 4 = 1 THEN 'CHILD_OF' ELSE 'KNOWS' END AS said FROM t WHERE n % 4 <> 0),
            p AS (SELECT t.doc, t.turn, max(CASE WHEN n % 2 = 0 THEN said = 'KNOWS' ELSE said = 'CHILD_OF' END) AS ok FROM t JOIN s ON s.doc = t.doc AND s.part = t.part AND ((s.a = t.o AND s.b = t.e) OR (s.a = t.e AND s.b = t.o)) GROUP BY ALL)
            SELECT 'fact' AS kind, doc, turn AS id, CASE WHEN n % 4 = 1 OR NOT (contains(said, lower(ws[3])) OR contains(lower(ws[3]), said)) THEN 'raw_none' WHEN who = e THEN 'raw_value_right_entity' ELSE 'raw_value_wrong_entity' END AS raw FROM f
            UNION ALL SELECT 'relationship', doc, turn, CASE WHEN ok IS NULL THEN 'raw_none' WHEN ok THEN 'raw_match' ELSE 'raw_other_relation' END FROM t LEFT JOIN p USING (doc, turn)""",
    ),
}
