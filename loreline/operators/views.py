"""What readers of a world look at: searches, facets, neighbours, windows of sentences, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S


def holds_any(needle: Column, *columns: Column) -> Column:
    """Whether a column contains the needle in any case; an empty needle fits all. Wildcard characters mean themselves."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(needle))
    return out


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with prefix, wildcard characters taken as they are; the filter reaches the scan."""
    return rows.where(F.col(column).startswith(prefix))


def ledger_tab(entities: DataFrame, tab: str, search: str, *columns: str) -> DataFrame:
    """Entities of a type (all: every one) that hold the search text in one of the columns."""
    rows = entities if tab == "all" else entities.where(F.col("entity_type") == tab)
    return rows.where(holds_any(F.lit(search), *[F.col(c) for c in columns]))


def visible_graph(nodes: DataFrame, edges: DataFrame, types: list[str], search: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, canonical_name, entity_type) of the types whose name or type holds the search text, and the edges
    (source_id, target_id) between two of them."""
    seen = nodes.where(F.col("entity_type").isin(*types) & holds_any(F.lit(search), F.col("canonical_name"), F.col("entity_type")))
    ids = seen.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return seen, kept.select(edges.columns)


def neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """focus_id and id of the nodes one edge away from each focus (id), either way, and of the focus itself."""
    f = focus.select(F.col("id").alias("focus_id"))
    out = edges.join(f, F.col("source_id") == F.col("focus_id")).select("focus_id", F.col("target_id").alias("id"))
    back = edges.join(f, F.col("target_id") == F.col("focus_id")).select("focus_id", F.col("source_id").alias("id"))
    return out.unionByName(back).unionByName(f.withColumn("id", F.col("focus_id"))).distinct()


def with_chapters(manuscripts: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Manuscripts that have a chapter. Chapters are reduced to their keys before they are dealt, so a popular one is no task of its own."""
    return manuscripts.join(chapters.select(key).distinct(), key, "left_semi")


def chapters_of_world(chapters: DataFrame, manuscripts: DataFrame, world: int) -> DataFrame:
    """Chapters whose manuscript belongs to the world; those of others are as if they did not exist."""
    return chapters.join(manuscripts.where(F.col("world_id") == world).select("manuscript_id"), "manuscript_id", "left_semi")


def same_address(left: Column, right: Column) -> Column:
    """Equal e-mail addresses or world names: but for case and outer white space."""
    return F.lower(F.trim(left)) == F.lower(F.trim(right))


def told_events(events: DataFrame) -> DataFrame:
    """Events of a type other than OTHER."""
    return events.where(F.upper(F.coalesce("event_type", F.lit(""))) != "OTHER")


def by_review(items: DataFrame) -> DataFrame:
    """Gold items (status) that count and pending ones, which are a zone to ignore: zone is gold or ignored; others go."""
    zone = F.when(F.col("status").isin("accepted", "corrected"), "gold").when(F.col("status") == "pending", "ignored")
    return items.withColumn("zone", zone).where("zone IS NOT NULL")


def first_of_each(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """Ordered dedupe: of rows with equal keys the one of the least place, in the order of places."""
    names = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*names), place).alias("r"))
    return best.select(*key, *[F.col("r").getField(c).alias(c) for c in names]).select(rows.columns)


def top_each(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order, as for a chat's facts, relations and citations."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("nth") <= most)


def pair_windows(mentions: DataFrame, most: int = 6) -> DataFrame:
    """doc, a, b (a < b), first and last sentence of the first windows of each pair of entities in mentions (doc, entity,
    sentence): sentences that name both, and two neighbours that name one each where neither names both."""
    m = mentions.select("doc", "entity", "sentence").distinct()
    other = m.select("doc", F.col("entity").alias("b"), F.explode(F.array(F.col("sentence") - 1, F.col("sentence"), F.col("sentence") + 1)).alias("sentence"), F.col("sentence").alias("there"))
    met = m.withColumnRenamed("entity", "a").join(other, ["doc", "sentence"]).where("a < b")
    both = met.where("sentence = there").select("doc", "a", "b", F.col("sentence").alias("first"), F.col("sentence").alias("last"))
    near = met.where("sentence <> there").select("doc", "a", "b", F.least("sentence", "there").alias("first"), F.greatest("sentence", "there").alias("last")).distinct()
    taken = both.select("doc", "a", "b", F.explode(F.array(F.col("first") - 1, F.col("first"))).alias("first"))
    windows = both.unionByName(near.join(taken, ["doc", "a", "b", "first"], "left_anti"))
    return top_each(windows, ["doc", "a", "b"], [F.col("first"), F.col("last")], most).drop("nth")


def next_version(versions: DataFrame, key: list[str]) -> DataFrame:
    """The number of the next version of each key: one more than there are, or than the largest where some were deleted."""
    return versions.groupBy(*key).agg((F.greatest(F.count("*"), F.coalesce(F.max("version_number"), F.lit(0))) + 1).alias("next_version"))


def request_totals(requests: DataFrame, key: list[str]) -> DataFrame:
    """Requests, prompt and output tokens, seconds, and replies that were cut off or gave no answer."""
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return requests.groupBy(*key).agg(
        F.count("*").alias("requests"), count("prompt_tokens", "prompt_tokens"), count("output_tokens", "output_tokens"), count("seconds", "seconds"),
        F.count_if("cut_off").alias("cut_off"), F.count_if(F.col("answer").isNull()).alias("unanswered"),
    )


def answer_quality(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a doc: gold facts, raw_found (an answer to their entity and property holds the value, or lies in it) and exact
    (one that was kept has it, but for case and white space). gold: id, doc, entity, property, value; answers the same
    without id, with result."""
    g, a = S.fold_spaces(F.col("g.value")), S.fold_spaces(F.col("a.value"))
    pairs = gold.alias("g").join(answers.where("value IS NOT NULL").alias("a"), ["doc", "entity", "property"], "left")
    fits = S.contains_either_way(g, a)
    one = pairs.groupBy("doc", "g.id").agg(F.max(F.coalesce(fits, F.lit(False))).alias("found"), F.max(F.coalesce(fits & (g == a) & (F.col("a.result") == "kept"), F.lit(False))).alias("same"))
    return one.groupBy("doc").agg(F.count("*").alias("gold"), F.count_if("found").alias("raw_found"), F.count_if("same").alias("exact"))


def sentence_at(points: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """points (key, at) with the text of the sentence (key, start, end, text) that holds the offset, white space collapsed;
    null where none does. Each point looks up the last sentence that starts no later, in one ordered pass over a key."""
    both = points.select(key, "at", F.lit(None).cast("struct<end:int,text:string>").alias("s")).withColumn("kind", F.lit(1)).unionByName(
        sentences.select(key, F.col("start").alias("at"), F.struct(F.col("end").cast("int").alias("end"), "text").alias("s")).withColumn("kind", F.lit(0))
    )
    last = F.last("s", ignorenulls=True).over(W.partitionBy(key).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("in", last).where("kind = 1")
    return found.select(key, "at", F.when(F.col("at") < F.col("in.end"), F.regexp_replace(F.trim(F.col("in.text")), r"(?U)\s+", " ")).alias("text"))


def sentence_with(values: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """values (id, key, value) with the first sentence (key, sentence, start, text) that holds the value in any case and with
    any white space between its words, and the place of the value in the chapter."""
    words = F.split(F.trim("value"), r"(?U)\s+")
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+")
    rows = values.where(~S.is_blank(F.col("value"))).withColumn("pattern", F.concat(F.lit("(?iU)"), quoted)).join(sentences, key)
    hit = F.regexp_substr("text", F.col("pattern"))
    rows = rows.withColumn("hit", hit).where("hit IS NOT NULL")
    rows = rows.withColumn("begin", F.col("start") + F.expr("instr(text, hit)") - 1)
    best = rows.groupBy("id").agg(F.min_by(F.struct("sentence", "begin", (F.col("begin") + F.length("hit")).alias("end")), "sentence").alias("b"))
    return values.select("id").join(best, "id", "left").select("id", "b.sentence", F.col("b.begin").alias("start"), F.col("b.end").alias("end"))


def chapter_title(text: Column) -> Column:
    """The first line with text among lines 2 to 6, if it is all in capitals; else null."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 2, 5), lambda x: F.trim(x)), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return F.when((F.upper(first) == first) & first.rlike(r"\p{L}"), first)
