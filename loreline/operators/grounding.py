"""Facts that a model answers about chunks of a text, kept where the text holds them: evidence is a quote, offsets are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import answers as A
from loreline.functions import scalars as S
from loreline.functions import vocabulary as V
from loreline.operators import extraction, spans
from loreline.operators import evaluate as ev

# Whom facts are about, what is never kept, and the longest value.
ABOUT = ("character", "organization")
NEVER = ("species",)
LONGEST = 40


def loose(text: Column) -> Column:
    """text as a pattern that finds it in any case, with any quotes for its quotes and any white space for its own."""
    out = F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    for kind in ("'‘’", '"“”'):
        out = F.regexp_replace(out, f"[{kind}]", f"[{kind}]")
    return F.regexp_replace(out, r"(?U)\s+", r"\\s+")


_FLAGS = "(?siU)"


def found_at(evidence: Column, value: Column, text: Column) -> Column:
    """Struct of start and value (as the text writes it) of value inside evidence in text, null unless every part of evidence is a quote from
    text and one holds the value. Parts lie between dots of omission; marks at their ends do not count. Places are code points."""
    strip = lambda p: F.regexp_replace(p, r"(?U)^[\s,;:'\"‘’“”]+|[\s,;:'\"‘’“”]+$", "")
    parts = F.filter(F.transform(F.split(evidence, r"\.\.\.|…"), strip), lambda p: F.length(p) > 0)
    want = loose(F.trim(value))
    quoted = F.forall(parts, lambda p: F.regexp_like(text, F.concat(F.lit(_FLAGS), loose(p))))
    part = F.get(F.filter(parts, lambda p: F.regexp_like(p, F.concat(F.lit(_FLAGS), want))), F.lit(0))
    # the first place of the part, then of the value in it
    before = F.call_function("regexp_extract", text, F.concat(F.lit(f"{_FLAGS}^(.*?)(?:"), loose(part), F.lit(")")), F.lit(1))
    quote = F.call_function("regexp_extract", text, F.concat(F.lit(f"{_FLAGS}^.*?("), loose(part), F.lit(")")), F.lit(1))
    inner = F.call_function("regexp_extract", quote, F.concat(F.lit(f"{_FLAGS}^(.*?)(?:"), want, F.lit(")")), F.lit(1))
    exact = F.call_function("regexp_extract", quote, F.concat(F.lit(f"{_FLAGS}^.*?("), want, F.lit(")")), F.lit(1))
    good = quoted & part.isNotNull() & (F.length(F.trim(value)) > 0)
    return F.when(F.coalesce(good, F.lit(False)), F.struct((F.length(before) + F.length(inner)).alias("start"), exact.alias("value")))


def chunk_names(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc, chunk, name (S.name_key), mention_id, entity and at: whom a name means in a chunk, the first mention of it that starts there. Pronouns other
    than those of the first person name no one, nor do entities that are most often of another type (of equals the least type)."""
    kinds = ev.majority_or_least(mentions, ["doc", "entity"], "type")
    known = mentions.join(kinds.where(F.col("type").isin(*ABOUT)).select("doc", "entity"), ["doc", "entity"], "left_semi")
    known = known.where(F.col("kind").isin("proper", "nominal") | F.lower("text").isin(*V.FIRST_PERSON)).withColumn("at", F.col("start"))
    inside = spans.at_points(known.select("doc", "at", "mention_id", "entity", "text"), chunks.select("doc", "chunk", "start", "end"), ["doc"], "at")
    rows = inside.select("doc", F.col("r.chunk").alias("chunk"), S.name_key(F.col("l.text")).alias("name"), F.col("l.at").alias("at"), F.col("l.mention_id").alias("mention_id"), F.col("l.entity").alias("entity"))
    return rows.groupBy("doc", "chunk", "name").agg(F.min(F.struct("at", "mention_id", "entity")).alias("m")).select("doc", "chunk", "name", "m.mention_id", "m.entity", "m.at")


def grounded(answers: DataFrame, chunks: DataFrame, texts: DataFrame, mentions: DataFrame, sentences: DataFrame, known: DataFrame, properties: tuple[str, ...] | None = None) -> DataFrame:
    """New facts: doc, fact_id, property, value, mention_id, start and end of the value in the text of the document.

    answers: doc, chunk, place, name, property, value, evidence. chunks: doc, chunk, start, end, text (no overlap). texts: doc, text. mentions: doc,
    mention_id, entity, type, kind, text, start. sentences: doc, start, end. known: doc, entity, property, value of the facts that there are.

    An answer is kept if its name is one of the chunk, its property is asked for, its value is short and plausible, and its
    evidence is found. A place takes the determiner in front of it in. Of facts that agree in entity, property and value in any case the first
    is kept, and none that is known. A fact is told of the mention that stands for its entity near the sentence of the name.
    """
    asked = F.lit(True) if properties is None else F.col("property").isin(*properties)
    value = F.trim("value")
    rows = answers.withColumns({"name": S.name_key(F.coalesce("name", F.lit(""))), "value": value}).where(asked & ~F.col("property").isin(*NEVER) & (F.length("value") > 0) & (F.length("value") <= LONGEST) & A.plausible(F.col("property"), F.col("value")))
    rows = rows.join(chunk_names(chunks, mentions), ["doc", "chunk", "name"]).join(chunks.select("doc", "chunk", F.col("start").alias("_chunk"), F.col("text").alias("_text")), ["doc", "chunk"])
    rows = rows.withColumn("hit", found_at(F.col("evidence"), F.col("value"), F.col("_text"))).where("hit IS NOT NULL").drop("_text")
    rows = rows.withColumns({"_start": F.col("_chunk") + F.col("hit.start"), "end": F.col("_chunk") + F.col("hit.start") + F.length("hit.value")}).join(texts.select("doc", "text"), "doc")
    rows = rows.withColumn("start", A.with_determiner(F.col("property"), F.col("text"), F.col("_start"))).withColumn("span", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    told = F.when(F.col("property") == "title", F.col("span")).otherwise(A.fact_value(F.col("property"), F.col("span")))
    rows = rows.withColumn("value", told).where("value IS NOT NULL").withColumn("folded", F.lower("value"))
    rows = rows.join(known.select("doc", "entity", "property", F.lower("value").alias("folded")), ["doc", "entity", "property", "folded"], "left_anti")
    first = rows.groupBy("doc", "entity", "property", "folded").agg(F.min(F.struct("chunk", "place", "value", "start", "end", "at")).alias("f")).select("doc", "entity", "property", "f.*")
    near = spans.at_points(first, sentences.select("doc", F.col("start"), F.col("end")), ["doc"], "at").select("doc", F.col("l.entity").alias("entity"), F.col("l.at").alias("at"), F.col("r.start").alias("low"), F.col("r.end").alias("high"))
    stands = extraction.representatives(mentions.withColumnRenamed("doc", "doc_id"), near.select(F.col("doc").alias("doc_id"), "entity", "low", "high").distinct()).withColumnRenamed("doc_id", "doc")
    out = first.join(near.distinct(), ["doc", "entity", "at"]).join(stands, ["doc", "entity", "low", "high"]).join(known.groupBy("doc").agg(F.count("*").alias("before")), "doc", "left")
    n = F.coalesce("before", F.lit(0)) + F.row_number().over(W.partitionBy("doc").orderBy("chunk", "place", "property", "value"))
    return out.select("doc", F.concat(F.lit("F"), n.cast("string")).alias("fact_id"), "property", "value", "mention_id", "start", "end")
