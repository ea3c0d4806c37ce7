"""Closed questions on entities: what context a question gets, which answers are copied from it, and what raw answers held.

mentions: doc, entity, text, type, kind, start. sentences: doc, sentence (number), start, end, text. chunks: doc, chunk, start, end,
without overlap. Models are never run here: answers are inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import evaluate, spans
from loreline.sources.shared import plain_unions

# Answers that say nothing, whom facts are asked of, windows a pair, and predicates of a parent.
NOTHING = ("", "none", "null", "n/a", "na", "unknown", "not stated", "not mentioned")
ASKED = ("character", "organization")
WINDOWS_PER_PAIR = 6
PARENTS = ("FATHER_OF", "MOTHER_OF", "PARENT_OF")
_FLAGS = "(?siU)"


def told(value: Column) -> Column:
    """An answer without white space runs and marks at its ends; null if it says nothing."""
    v = F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    return F.when(~F.lower(v).isin(*NOTHING), v)


def _pattern(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), " ", r"\\s+")


def names(mentions: DataFrame) -> DataFrame:
    """doc, entity, name and type: the most frequent text of proper mentions, else of nominal ones, of equals the one seen first;
    entities that have only pronouns are left out. The type is the most frequent, of equals the least."""
    rank = F.when(F.col("kind") == "proper", 0).when(F.col("kind") == "nominal", 1)
    rows = mentions.withColumns({"rank": rank, "name": F.regexp_replace(F.trim("text"), r"(?U)\s+", " ")}).where("rank IS NOT NULL")
    counted = rows.groupBy("doc", "entity", "rank", "name").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    best = counted.groupBy("doc", "entity").agg(F.min_by("name", F.struct("rank", -F.col("n"), "first", "name")).alias("name"))
    return best.join(evaluate.majority_or_least(mentions, ["doc", "entity"], "type"), ["doc", "entity"])


def mentioned(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc, entity, sentence: the sentences with a mention, each once. Between two sentences the later one counts."""
    since = F.coalesce(F.lag("end").over(W.partitionBy("doc").orderBy("sentence")), F.lit(0))
    wide = sentences.select("doc", "sentence", since.alias("start"), "end")
    found = spans.at_points(mentions.select("doc", "entity", F.col("start").alias("at")), wide, ["doc"], "at")
    return found.select("doc", F.col("l.entity").alias("entity"), F.col("r.sentence").alias("sentence")).distinct()


def fact_windows(mentions: DataFrame, sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, chunk, entity, name, window (array of sentence, start, end, text) and context: for each entity that is asked of and each chunk,
    the sentences that start in the chunk and mention it. A window is at most its chunk."""
    ask = names(mentions).where(F.col("type").isin(*ASKED))
    here = mentioned(mentions, sentences).join(ask.select("doc", "entity"), ["doc", "entity"], "left_semi").join(sentences, ["doc", "sentence"])
    within = spans.at_points(here.withColumnsRenamed({"start": "at", "end": "stop"}), chunks.select("doc", "chunk", "start", "end"), ["doc"], "at")
    line = F.struct(F.col("l.sentence").alias("sentence"), F.col("l.at").alias("start"), F.col("l.stop").alias("end"), F.col("l.text").alias("text"))
    rows = within.groupBy("doc", F.col("r.chunk").alias("chunk"), F.col("l.entity").alias("entity")).agg(F.array_sort(F.collect_list(line)).alias("window"))
    context = F.array_join(F.transform("window", lambda s: s["text"]), "\n")
    return rows.join(ask.select("doc", "entity", "name"), ["doc", "entity"]).select("doc", "chunk", "entity", "name", "window", context.alias("context"))


def checked_values(answers: DataFrame, windows: DataFrame) -> DataFrame:
    """answers (doc, chunk, entity, property, value) with a result: none (says nothing), invalid (not copied from the window, or there is
    none) or kept, then with value as the text writes it, its start and end, and sentence, the first of the window that holds it in any case and with any white
    space between its words."""
    rows = answers.withColumn("value", told(F.col("value"))).join(windows.select("doc", "chunk", "entity", "window"), ["doc", "chunk", "entity"], "left")
    pattern = _pattern(F.col("value"))
    rows = rows.withColumns({"_p": pattern, "hit": F.get(F.filter("window", lambda s: F.regexp_like(s["text"], F.concat(F.lit(_FLAGS), pattern))), F.lit(0))})
    part = lambda before, after: F.call_function("regexp_extract", F.col("hit.text"), F.concat(F.lit(_FLAGS + before), F.col("_p"), F.lit(after)), F.lit(1))
    found = F.col("hit").isNotNull()
    result = F.when(F.col("value").isNull(), "none").when(found, "kept").otherwise("invalid")
    start = F.when(found, F.col("hit.start") + F.length(part("^(.*?)(?:", ")")))
    rows = rows.withColumns({"result": result, "start": start, "value": F.when(found, part("^.*?(", ")")).otherwise(F.col("value"))})
    return rows.select("doc", "chunk", "entity", "property", "value", "result", "start", (F.col("start") + F.length("value")).alias("end"), F.col("hit.sentence").alias("sentence"))


def pair_windows(places: DataFrame, most: int = WINDOWS_PER_PAIR) -> DataFrame:
    """doc, a, b (a < b), low, high: the sentences to ask about a pair, from places (doc, entity, sentence): sentences that mention both, and two in a row that mention
    one each where neither mentions both. The first of each pair in text order; most is part of the question, None gives all."""
    plain_unions(places.sparkSession)
    x, y = places.select("doc", F.col("entity").alias("a"), "sentence"), places.select("doc", F.col("entity").alias("b"), "sentence")
    both = x.join(y, ["doc", "sentence"]).where("a < b").select("doc", "a", "b", "sentence")
    after = x.join(y.withColumn("sentence", F.col("sentence") - 1), ["doc", "sentence"]).where("a <> b")
    near = after.select("doc", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sentence").distinct()
    taken = both.select("doc", "a", "b", F.explode(F.array("sentence", F.col("sentence") - 1)).alias("sentence"))
    two = near.join(taken, ["doc", "a", "b", "sentence"], "left_anti")
    rows = both.withColumn("high", F.col("sentence")).unionByName(two.withColumn("high", F.col("sentence") + 1)).withColumnRenamed("sentence", "low")
    if most is not None:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("doc", "a", "b").orderBy("low", "high"))).where(F.col("_r") <= most).drop("_r")
    return rows.select("doc", "a", "b", "low", "high")


def _spoken_of(asked: DataFrame, known: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, chunk, entity, name: for asked (doc, chunk, entity) the keys of its names (known: doc, entity, name) and of its mentions in the chunk."""
    inside = spans.at_points(mentions.select("doc", "entity", "text", F.col("start").alias("at")), chunks.select("doc", "chunk", "start", "end"), ["doc"], "at")
    here = inside.select("doc", F.col("r.chunk").alias("chunk"), F.col("l.entity").alias("entity"), S.name_key(F.col("l.text")).alias("name")).join(asked, ["doc", "chunk", "entity"], "left_semi")
    return asked.join(known, ["doc", "entity"]).select("doc", "chunk", "entity", S.name_key(F.col("name")).alias("name")).unionByName(here).distinct()


def fact_attribution(facts: DataFrame, raw: DataFrame, known: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, id, raw: whether raw answers (doc, chunk, name, property, value) for the chunk with a gold fact's evidence hold its value, or a
    part or extension of it, for its entity (raw_value_right_entity), for another one, or not (raw_none). facts: doc, id, entity, property, value, at."""
    plain_unions(facts.sparkSession)
    claims = spans.at_points(facts, chunks.select("doc", "chunk", "start", "end"), ["doc"], "at").select("doc", "r.chunk", *[F.col(f"l.{c}").alias(c) for c in ("id", "entity", "property", "value")])
    said = raw.select("doc", "chunk", "property", S.name_key(F.col("name")).alias("name"), S.fold_spaces(F.col("value")).alias("_said"))
    value = S.fold_spaces(F.col("value"))
    alike = (F.length(value) > 0) & (F.length("_said") > 0) & (F.contains(value, F.col("_said")) | F.contains(F.col("_said"), value))
    hits = claims.join(said, ["doc", "chunk", "property"]).where(alike)
    own = _spoken_of(claims.select("doc", "chunk", "entity").distinct(), known, mentions, chunks).withColumn("right", F.lit(True))
    best = hits.join(own, ["doc", "chunk", "entity", "name"], "left").groupBy("doc", "id").agg(F.coalesce(F.max("right"), F.lit(False)).alias("right"))
    kind = F.when(F.col("right"), "raw_value_right_entity").when(~F.col("right"), "raw_value_wrong_entity").otherwise("raw_none")
    return claims.select("doc", "id").join(best, ["doc", "id"], "left").select("doc", "id", kind.alias("raw"))


def relation_attribution(relations: DataFrame, raw: DataFrame, known: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc, id, raw: whether raw answers (doc, chunk, subject, relation, object) for the chunk of a gold relation's evidence name both of its
    ends, in either order, with its predicate (raw_match; for parents any way round), with another one, or not. relations: doc, id,
    subject, predicate, object, at. Names are looked up by equality on each end, so no answer meets claims on other names."""
    plain_unions(relations.sparkSession)
    claims = spans.at_points(relations, chunks.select("doc", "chunk", "start", "end"), ["doc"], "at").select("doc", "r.chunk", *[F.col(f"l.{c}").alias(c) for c in ("id", "subject", "predicate", "object")])
    asked = claims.select("doc", "chunk", F.explode(F.array("subject", "object")).alias("entity")).distinct()
    own = _spoken_of(asked, known, mentions, chunks)
    end = lambda c: own.withColumnsRenamed({"entity": c, "name": f"{c}_name"})
    named = claims.join(end("subject"), ["doc", "chunk", "subject"]).join(end("object"), ["doc", "chunk", "object"])
    said = raw.select("doc", "chunk", S.name_key(F.col("subject")).alias("s"), S.name_key(F.col("object")).alias("o"), F.upper("relation").alias("said")).where("s IS NOT NULL AND o IS NOT NULL")
    either = F.explode(F.array(F.struct(F.col("s").alias("subject_name"), F.col("o").alias("object_name")), F.struct(F.col("o").alias("subject_name"), F.col("s").alias("object_name")))).alias("e")
    pairs = named.join(said.select("doc", "chunk", "said", either).select("doc", "chunk", "said", "e.*").distinct(), ["doc", "chunk", "subject_name", "object_name"])
    same = F.when(F.col("predicate").isin(*PARENTS), F.col("said").isin("PARENT_OF", "CHILD_OF")).otherwise(F.col("said") == F.col("predicate"))
    best = pairs.groupBy("doc", "id").agg(F.max(F.coalesce(same, F.lit(False))).alias("ok"))
    kind = F.when(F.col("ok"), "raw_match").when(~F.col("ok"), "raw_other_relation").otherwise("raw_none")
    return claims.select("doc", "id").join(best, ["doc", "id"], "left").select("doc", "id", kind.alias("raw"))
