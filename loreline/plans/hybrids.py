"""Queries over documents that are part gold, part predicted, and over relations asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.operators import hybrids
from loreline.sources.shared import dealt
from loreline.sources.worlds import World


def lines(w: World) -> DataFrame:
    return w.raw("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).alias("mode"))


def report(w: World) -> DataFrame:
    """Lines as answers about pairs of part and supplier, and as predictions of a class."""
    x = lines(w).withColumnsRenamed({"l_partkey": "a", "l_suppkey": "b"})
    result = F.when(F.col("l_returnflag") == "A", "kept").when(F.col("l_returnflag") == "R", "invalid").otherwise("none")
    classes = x.select("mode", F.when(F.col("l_linestatus") == "F", "tp").otherwise("false_positive").alias("class"))
    return hybrids.relation_report(x.withColumn("result", result), classes, ["mode"])


def candidates(w: World) -> DataFrame:
    """Suppliers as entities, lines as sentences, orders as documents."""
    x = lines(w).select("doc", F.col("l_suppkey").alias("entity"), F.col("line").alias("sentence"))
    kinds = x.select("doc", "entity").distinct().withColumn("type", F.element_at(F.array(*map(F.lit, ("character", "location", "object"))), (F.col("entity") % 3 + 1).cast("int")))
    return hybrids.candidate_pairs(x, kinds)


def oracle(w: World) -> DataFrame:
    """Suppliers as groups, parts by their last digit as the gold entities they resolve to."""
    digit = F.col("l_partkey") % 10
    resolved = lines(w).select("doc", F.col("l_suppkey").alias("group"), digit.alias("entity"))
    return hybrids.oracle_pairs(resolved, lines(w).select("doc", digit.alias("subject"), ((F.col("l_partkey") + 1) % 10).alias("object")))


def hybrid(w: World) -> DataFrame:
    """Lines as spans of ten; gold up to 35, predictions two behind each of them."""
    span = lambda shift: lines(w).select("doc", (F.col("line") * 2 + shift).alias("id"), F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("type"), F.lit("proper").alias("kind"), (F.col("line") * 10 + 2 * shift).alias("start"), (F.col("line") * 10 + 2 * shift + 5).alias("end"), F.col("l_partkey").alias("entity"))
    rows = 2 * w.raw("lineitem").count()
    cuts = dealt(lines(w).select("doc"), "doc", rows=rows).distinct().withColumn("end", F.lit(35))
    return hybrids.hybrid_mentions(span(0), span(1).drop("entity"), cuts, rows).select("doc", "id", "start", "gold_id", "entity")


QUERIES = {
    "relation_report": (
        report,
        "SELECT l_suppkey % 7 AS mode, count(*) AS questions, count(DISTINCT (l_orderkey, least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey))) AS pairs, "
        "count(*) FILTER (l_returnflag = 'A') AS kept, count(*) FILTER (l_returnflag = 'R') AS invalid, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS none, "
        "count(*) FILTER (l_linestatus = 'F') AS found, count(*) FILTER (l_linestatus <> 'F') AS errors, "
        "CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'R')) > 0 THEN count(*) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag IN ('A', 'R')) END AS valid FROM lineitem GROUP BY 1",
    ),
    "candidate_pairs": (
        candidates,
        "SELECT DISTINCT x.l_orderkey AS doc, x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey AND abs(x.l_linenumber - y.l_linenumber) <= 1 "
        "WHERE x.l_suppkey % 3 < 2 AND y.l_suppkey % 3 < 2 AND NOT (x.l_suppkey % 3 = 1 AND y.l_suppkey % 3 = 1)",
    ),
    "oracle_pairs": (
        oracle,
        "WITH best AS (SELECT l_orderkey, l_partkey % 10 AS entity, l_suppkey AS g FROM lineitem GROUP BY l_orderkey, l_partkey % 10, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 10 ORDER BY count(*) DESC, l_suppkey) = 1) "
        "SELECT DISTINCT l.l_orderkey AS doc, least(s.g, o.g) AS a, greatest(s.g, o.g) AS b FROM lineitem l JOIN best s ON s.l_orderkey = l.l_orderkey AND s.entity = l.l_partkey % 10 "
        "JOIN best o ON o.l_orderkey = l.l_orderkey AND o.entity = (l.l_partkey + 1) % 10 WHERE s.g <> o.g",
    ),
    "hybrid_mentions": (
        hybrid,
        "WITH m AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS start, l_linenumber * 2 AS gold_id, l_partkey AS entity FROM lineitem WHERE l_linenumber * 10 + 5 <= 35 "
        "UNION ALL SELECT l_orderkey, l_linenumber * 10 + 2, NULL, NULL FROM lineitem WHERE l_linenumber * 10 + 2 >= 35) "
        "SELECT doc, 'M' || row_number() OVER (PARTITION BY doc ORDER BY start, entity) AS id, CAST(start AS BIGINT) AS start, CAST(gold_id AS BIGINT) AS gold_id, CAST(entity AS BIGINT) AS entity FROM m",
    ),
}
