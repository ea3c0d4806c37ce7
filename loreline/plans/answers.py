"""Queries over answers of models: facts said of turns of conversations, and clusters of lines as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import grounding, linking
from loreline.sources.worlds import World


def turns(w: World) -> DataFrame:
    """Turns of four words and more as chunks of their conversation: doc, chunk, text, words, start, end."""
    rows = w.raw("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("chunk"), F.trim("text").alias("text")).withColumn("words", F.split("text", r"\s+")).where(F.size("words") >= 4)
    upto = F.sum(F.length("text") + 1).over(W.partitionBy("doc").orderBy("chunk")) - 1
    return rows.withColumns({"end": upto, "start": upto - F.length("text")})


def grounded(w: World) -> DataFrame:
    """Each turn's first word has its third as occupation, on the evidence of its first four in small letters."""
    x = turns(w)
    first = F.col("words")[0]
    answers = x.select("doc", "chunk", F.lit(0).alias("place"), first.alias("name"), F.lit("occupation").alias("property"), F.lower(F.col("words")[2]).alias("value"), F.lower(F.array_join(F.slice("words", 1, 4), "  ")).alias("evidence"))
    mentions = x.select("doc", F.concat(F.lit("M"), "chunk").alias("mention_id"), F.lower(first).alias("entity"), F.lit("character").alias("type"), F.lit("proper").alias("kind"), first.alias("text"), "start")
    texts = x.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda t: t["text"]), "\n").alias("text"))
    known = x.where("chunk = 0").select("doc", F.lower(first).alias("entity"), F.lit("occupation").alias("property"), F.col("words")[1].alias("value"))
    return grounding.grounded(answers, x.select("doc", "chunk", "start", "end", "text"), texts, mentions, x.select("doc", "start", "end"), known).select("doc", "fact_id", "value", "mention_id", "start", "end")


def linked(w: World) -> DataFrame:
    """Sixteen orders are a document, lines the spans of their clusters; orders are the known mentions."""
    found = w.raw("lineitem").groupBy(F.floor(F.col("l_orderkey") / 16).alias("doc_id"), (F.col("l_orderkey") % 16).cast("int").alias("cluster"), F.col("l_linenumber").alias("place")).agg(F.min(F.col("l_partkey") % 400).alias("start"))
    found = found.withColumns({"end": F.col("start") + 2, "kind": F.element_at(F.array(*map(F.lit, ("pronominal", "proper", "nominal"))), (F.col("start") % 3 + 1).cast("int")), "text": F.when(F.col("start") % 2 == 0, "she").otherwise("it")})
    mentions = w.raw("orders").select(F.floor(F.col("o_orderkey") / 16).alias("doc_id"), F.concat(F.lit("M"), (F.col("o_orderkey") % 16 + 1).cast("string")).alias("mention_id"), (F.col("o_custkey") % 400).alias("start"), (F.col("o_custkey") % 400 + 3).alias("end"), F.lit("character").alias("type"))
    new, members = linking.link(found, mentions)
    return members.groupBy("doc_id").agg(F.count_distinct("cluster_id").alias("clusters"), F.count("*").alias("members")).join(new.groupBy("doc_id").agg(F.count("*").alias("new")), "doc_id", "left").fillna(0, ["new"])


QUERIES = {
    "grounded_facts": (
        grounded,
        r"""WITH x AS (SELECT conv_id AS doc, turn AS chunk, trim(text) AS text, regexp_split_to_array(trim(text), '\s+') AS ws FROM conversations),
            t AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY chunk) - 1 - length(text) AS base FROM x WHERE len(ws) >= 4),
            r AS (SELECT *, lower(ws[1]) AS entity, lower(ws[3]) AS folded, base + strpos(lower(text), lower(ws[1])) - 1 AS first FROM t WHERE length(ws[3]) <= 40 AND NOT regexp_matches(ws[3], '\d')),
            k AS (SELECT DISTINCT doc, lower(ws[1]) AS entity, lower(ws[2]) AS folded FROM t WHERE chunk = 0),
            n AS (SELECT doc, count(*) AS before FROM t WHERE chunk = 0 GROUP BY doc),
            f AS (SELECT r.*, row_number() OVER (PARTITION BY doc, entity, folded ORDER BY chunk) AS nth FROM r ANTI JOIN k USING (doc, entity, folded))
            SELECT doc, 'F' || (coalesce(before, 0) + row_number() OVER (PARTITION BY doc ORDER BY chunk)) AS fact_id, text[place:place + length(ws[3]) - 1] AS value, 'M' || chunk AS mention_id, base + place - 1 AS start, base + place - 1 + length(ws[3]) AS "end"
            FROM (SELECT *, strpos(lower(text), folded) AS place FROM f WHERE nth = 1) LEFT JOIN n USING (doc)""",
    ),
    "linked_clusters": (linked, None),
}
