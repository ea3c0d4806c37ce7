"""Documents that are part gold, part predicted, to tell which step of an extraction loses what; and reports on relations.

Mentions have doc, id, text, type, kind, start, end; gold ones also entity (or null). cuts: doc and end of the gold region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import evaluate as ev
from loreline.operators import views
from loreline.sources.shared import dealt, plain_unions

MENTION = ["doc", "text", "type", "kind", "start", "end"]


def region_ends(gold: DataFrame) -> DataFrame:
    """doc and end of where mentions are annotated, from doc, text and region_end (null: all of the text)."""
    return gold.select("doc", F.coalesce("region_end", F.length("text")).alias("end"))


def hybrid_mentions(gold: DataFrame, pred: DataFrame, cuts: DataFrame, rows: int | None = None) -> DataFrame:
    """Gold mentions inside the region and predicted ones that start behind it, numbered M1, M2, ... in text order (of one
    start the longer first, gold before predicted, then by id and what else they hold): id, the columns of mentions, gold_id and entity (null if predicted).
    rows: how many gold and pred have, if known. Both are dealt out by document once, and meet the cuts and are numbered there."""
    types = dict(gold.dtypes)
    annotated = gold.select(*MENTION, F.col("id").alias("gold_id"), "entity", F.col("id").alias("was"), F.lit(True).alias("gold"))
    predicted = pred.select(*MENTION, F.lit(None).cast(types["id"]).alias("gold_id"), F.lit(None).cast(types["entity"]).alias("entity"), F.col("id").alias("was"), F.lit(False).alias("gold"))
    mentions = annotated.unionByName(predicted)
    rows = mentions.count() if rows is None else rows
    # the cuts are dealt out likewise, or the join would deal the mentions as the cuts happen to be
    mentions = dealt(mentions, "doc", rows=rows).join(dealt(cuts.select("doc", F.col("end").alias("cut")), "doc", rows=rows), "doc")
    place = W.partitionBy("doc").orderBy("start", F.desc("end"), F.col("gold_id").isNull(), "was", "entity", "type", "text", "kind")
    kept = mentions.where("CASE WHEN gold THEN end <= cut ELSE start >= cut END")
    return kept.select(*MENTION, "gold_id", "entity", F.concat(F.lit("M"), F.row_number().over(place)).alias("id"))


def without_added(mentions: DataFrame, members: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mentions (with gold_id) without those that a later step added inside the region, and members (doc, cluster, id) of what
    is left; clusters of one go. mentions are often a union of windowed tables: see plain_unions."""
    plain_unions(mentions.sparkSession)
    added = mentions.join(cuts.select("doc", F.col("end").alias("cut")), "doc").where("end <= cut AND gold_id IS NULL").select("doc", "id")
    left = members.join(added, ["doc", "id"], "left_anti")
    several = left.groupBy("doc", "cluster").agg(F.count("*").alias("n")).where("n > 1").select("doc", "cluster")
    return mentions.join(added, ["doc", "id"], "left_anti"), left.join(several, ["doc", "cluster"], "left_semi").select("doc", "cluster", "id")


def gold_clusters(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """doc, id, cluster, how: gold mentions by their entity; predicted ones of a cluster by the entity that most gold mentions of
    the cluster have (how: joined), else, on a tie or without gold, by the cluster itself (kept). Clusters of one go."""
    known = mentions.select("doc", "id", "gold_id", "entity")
    own = known.where("gold_id IS NOT NULL AND entity IS NOT NULL").select("doc", "id", F.concat(F.lit("gold:"), "entity").alias("cluster"), F.lit("gold").alias("how"))
    rows = members.join(known, ["doc", "id"])
    won = ev.majority(rows, ["doc", "cluster"], "entity").select("doc", "cluster", F.col("entity").alias("won"))
    to = F.coalesce(F.concat(F.lit("gold:"), "won"), F.concat(F.lit("pred:"), "cluster"))
    others = rows.where("gold_id IS NULL").join(won, ["doc", "cluster"], "left").select("doc", "id", to.alias("cluster"), F.when(F.col("won").isNotNull(), "joined").otherwise("kept").alias("how"))
    return own.unionByName(others).withColumn("n", F.count("*").over(W.partitionBy("doc", "cluster"))).where("n > 1").drop("n")


def candidate_pairs(mentions: DataFrame, kinds: DataFrame) -> DataFrame:
    """doc, a, b (a < b) of entities named in one sentence or in two neighbours, in mentions (doc, entity, sentence). kinds (doc,
    entity, type): of two locations none is asked, nor of any other type."""
    ok = kinds.where(F.col("type").isin("character", "organization", "location")).select("doc", "entity", "type")
    pairs = views.pair_windows(mentions.join(ok, ["doc", "entity"], "left_semi"), 1).select("doc", "a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(ok.select("doc", F.col("entity").alias(end), (F.col("type") == "location").alias(f"{end}_place")), ["doc", end])
    return pairs.where("NOT (a_place AND b_place)").select("doc", "a", "b")


def oracle_pairs(resolved: DataFrame, relations: DataFrame) -> DataFrame:
    """doc, a, b (a < b): the groups that stand for both ends of a gold relation (doc, subject, object). A gold entity is stood for by the
    group with most mentions that resolve to it, of equals the least, in resolved (doc, group, entity)."""
    votes = resolved.where("entity IS NOT NULL").groupBy("doc", "entity", "group").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc", "entity").agg(F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("group"))
    rows = relations.select("doc", "subject", "object")
    for end, name in (("subject", "s"), ("object", "o")):
        rows = rows.join(best.select("doc", F.col("entity").alias(end), F.col("group").alias(name)), ["doc", end])
    return rows.where("s <> o").select("doc", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def relation_report(answers: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key of by: questions, pairs asked, answers kept, invalid and none (answers: doc, a, b, result), the share of
    given answers whose evidence is valid (null without any), and found and errors of predictions (classes: class)."""
    result = lambda r: F.count_if(F.col("result") == r).alias(r)
    asked = answers.groupBy(*by).agg(F.count("*").alias("questions"), F.count_distinct("doc", F.least("a", "b"), F.greatest("a", "b")).alias("pairs"), *[result(r) for r in ("kept", "invalid", "none")])
    good: Column = F.col("class").isin("tp", "lenient_only")
    told = classes.groupBy(*by).agg(F.count_if(good).alias("found"), F.count_if(~good).alias("errors"))
    out = asked.join(told, by, "left").fillna(0, ["found", "errors"])
    return out.withColumn("valid", F.when(F.col("kept") + F.col("invalid") > 0, F.col("kept") / (F.col("kept") + F.col("invalid"))))


def naming_links(texts: DataFrame, mentions: DataFrame, members: DataFrame) -> DataFrame:
    """doc, a, b of mentions that a text says are one: a possessive and the proper name behind "my name is", and an "I" of the narrator
    and the character behind "this is" or "I am". The narrator is the cluster of members (doc, cluster, id) with most "I", of
    equals the least; without one there are no links of the second kind."""
    # The phrases.
    own = r"\b(?:[Mm]y|[Hh]is|[Hh]er|[Tt]heir|[Oo]ur|[Yy]our) name(?:\s+is|\s+was|['’]s)\s+"
    self = r"\b(?:[Tt]his is|I am|I['’]m)\s+"

    def ends(pattern: str) -> DataFrame:
        """doc, at and end of each match; what stands between matches is measured, so that places are code points."""
        rows = texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(.*?)({pattern})"), F.lit(1))).alias("n", "gap"), F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("hits"))
        rows = rows.select("doc", "n", F.length("gap").alias("gap"), F.length(F.col("hits")[F.col("n")]).alias("size"))
        upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("doc").orderBy("n"))
        return rows.select("doc", (upto - F.col("size")).alias("at"), upto.alias("end"))

    proper = mentions.where("kind = 'proper'").select("doc", F.col("start").alias("end"), F.col("id").alias("b"), "type")
    owner = mentions.where("kind = 'pronominal'").select("doc", F.col("start").alias("at"), F.col("id").alias("a"))
    first = ends(own).join(owner, ["doc", "at"]).join(proper, ["doc", "end"]).select("doc", "a", "b")
    i = members.join(mentions.where("lower(text) = 'i'").select("doc", "id", "start"), ["doc", "id"]).groupBy("doc", "cluster").agg(F.count("*").alias("n"), F.min_by("id", "start").alias("a"))
    narrator = i.groupBy("doc").agg(F.min_by("a", F.struct(-F.col("n"), F.col("cluster"))).alias("a"))
    second = ends(self).join(proper.where("type = 'character'"), ["doc", "end"]).join(narrator, "doc").select("doc", "a", "b")
    return first.unionByName(second).distinct()
