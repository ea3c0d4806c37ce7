"""Clusters of a coreference model joined to known mentions, with the mentions that they bring along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import spans
from loreline.sources.shared import plain_unions, settled

# Pronouns that stand for persons.
PERSONAL = (
    "i me my mine myself we us our ours ourselves you your yours yourself he him his himself she her hers herself "
    "they them their theirs themselves"
).split()


def link(found: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New mentions and the members of clusters, from spans of a model and the mentions of documents.

    found: doc_id, cluster (its place among the document's), place (of the span in it), start, end, kind, text. mentions: doc_id,
    mention_id, start, end, type. A span stands for the mention that it is aligned to. Of the others a cluster brings along its pronouns,
    and short proper names where it has a mention and they overlap none, also none that an earlier cluster has brought. It is left out if it has no
    type (the most frequent of its mentions, of equals the first; else character if it brings a personal pronoun) or
    fewer than two members. A span belongs to the first cluster that brings it.

    Returns new mentions (doc_id, mention_id, start, end, type, kind, text), numbered behind the old ones, and members
    (doc_id, cluster_id, mention_id, place), C1, C2, ... in order of their clusters.

    Clusters depend on earlier ones only where their spans meet. In each round all clusters decide that meet no earlier undecided
    one, so there are as many rounds as the longest chain of meetings, and no document is walked as a whole. A round ends in a checkpoint.
    """
    plain_unions(found.sparkSession)
    one = found.groupBy("doc_id", "cluster", "start", "end").agg(F.min("place").alias("first"))
    ids = found.select("doc_id", (F.shiftleft(F.col("cluster").cast("long"), 32) + F.col("place")).alias("id"), "start", "end")
    pairs = spans.align(ids, mentions.select("doc_id", F.col("mention_id").alias("id"), "start", "end"), ["doc_id"])
    aligned = settled(pairs.select("doc_id", F.shiftright("pred_id", 32).cast("int").alias("cluster"), F.col("pred_id").bitwiseAND((1 << 32) - 1).cast("int").alias("place"), F.col("gold_id").alias("mention_id")).join(mentions.select("doc_id", "mention_id", "type"), ["doc_id", "mention_id"]))
    votes = aligned.groupBy("doc_id", "cluster", "type").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    types = votes.groupBy("doc_id", "cluster").agg(F.sum("n").alias("members"), F.max_by("type", F.struct("n", -F.col("place"))).alias("type"))

    loose = found.join(aligned.select("doc_id", "cluster", "place"), ["doc_id", "cluster", "place"], "left_anti").join(one.select("doc_id", "cluster", "start", "end", F.col("first").alias("place")), ["doc_id", "cluster", "start", "end", "place"], "left_semi")
    touching = spans.overlapping(loose.where("kind = 'proper'").select("doc_id", "cluster", "place", "start", "end"), mentions.select("doc_id", "start", "end"), ["doc_id"]).select("doc_id", F.col("l.cluster").alias("cluster"), F.col("l.place").alias("place")).distinct()
    named = loose.where("kind = 'proper'").join(types.select("doc_id", "cluster"), ["doc_id", "cluster"], "left_semi").join(touching, ["doc_id", "cluster", "place"], "left_anti")
    offered = settled(loose.where("kind = 'pronominal'").select("doc_id", "cluster", "place", "start", "end", "kind", "text").unionByName(named.select("doc_id", "cluster", "place", "start", "end", "kind", "text")))

    # what an offer gives way to: the same span, or, for a name, one that it overlaps, brought by an earlier cluster
    meets = spans.overlapping(offered.select("doc_id", "cluster", "place", "start", "end", "kind"), offered.select("doc_id", "cluster", "place", "start", "end"), ["doc_id"])
    same = (F.col("l.start") == F.col("r.start")) & (F.col("l.end") == F.col("r.end"))
    meets = settled(meets.where((F.col("r.cluster") < F.col("l.cluster")) & (same | (F.col("l.kind") == "proper"))).select("doc_id", F.col("l.cluster").alias("cluster"), F.col("l.place").alias("place"), F.col("r.cluster").alias("earlier"), F.col("r.place").alias("its")))

    left = settled(found.select("doc_id", "cluster").distinct().join(types, ["doc_id", "cluster"], "left"))
    # each round writes what it decides and goes on with what is open; the rounds before are not written again
    rounds: list[tuple[DataFrame, DataFrame]] = []
    blocked = None
    while not left.isEmpty():
        waits = meets.join(left.select("doc_id", F.col("cluster").alias("earlier")), ["doc_id", "earlier"], "left_semi").select("doc_id", "cluster").distinct()
        ready = left.join(waits, ["doc_id", "cluster"], "left_anti")
        own = offered.join(ready.select("doc_id", "cluster"), ["doc_id", "cluster"], "left_semi")
        if blocked is not None:
            own = own.join(blocked, ["doc_id", "cluster", "place"], "left_anti")
        sums = own.groupBy("doc_id", "cluster").agg(F.count("*").alias("new"), F.max(F.lower("text").isin(*PERSONAL)).alias("person"))
        typed = ready.join(sums, ["doc_id", "cluster"], "left").fillna(0, ["members", "new"]).withColumn("type", F.coalesce("type", F.when(F.col("person"), "character")))
        good = settled(typed.where("type IS NOT NULL AND members + new >= 2").select("doc_id", "cluster", "type"))
        fresh = settled(own.join(good, ["doc_id", "cluster"]))
        rounds.append((fresh, good))
        left = settled(left.join(waits, ["doc_id", "cluster"], "left_semi"))
        open_ = left.select("doc_id", "cluster")
        taken = meets.join(fresh.select("doc_id", F.col("cluster").alias("earlier"), F.col("place").alias("its")), ["doc_id", "earlier", "its"], "left_semi").select("doc_id", "cluster", "place")
        taken = taken if blocked is None else taken.unionByName(blocked)
        blocked = settled(taken.distinct().join(open_, ["doc_id", "cluster"], "left_semi"))
        meets, offered = settled(meets.join(open_, ["doc_id", "cluster"], "left_semi")), settled(offered.join(open_, ["doc_id", "cluster"], "left_semi"))
    kept = None
    for fresh, good in rounds:
        brought, kept = (fresh, good) if kept is None else (brought.unionByName(fresh), kept.unionByName(good))
    if kept is None:
        kind = dict(found.dtypes)
        return found.sparkSession.createDataFrame([], f"doc_id {kind['doc_id']}, mention_id string, start {kind['start']}, end {kind['end']}, type string, kind string, text string"), found.sparkSession.createDataFrame([], f"doc_id {kind['doc_id']}, cluster_id string, mention_id string, place int")

    behind = mentions.groupBy("doc_id").agg(F.count("*").alias("known"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("cluster", "place"))
    new = brought.withColumn("nth", nth).join(behind, "doc_id", "left").withColumn("mention_id", F.concat(F.lit("M"), (F.coalesce("known", F.lit(0)) + F.col("nth")).cast("string")))
    numbered = kept.withColumn("cluster_id", F.concat(F.lit("C"), F.row_number().over(W.partitionBy("doc_id").orderBy("cluster")).cast("string"))).select("doc_id", "cluster", "cluster_id")
    members = aligned.select("doc_id", "cluster", "mention_id", F.lit(0).alias("side"), "place").unionByName(new.select("doc_id", "cluster", "mention_id", F.lit(1).alias("side"), "place"))
    order = F.row_number().over(W.partitionBy("doc_id", "cluster").orderBy("side", "place"))
    return new.select("doc_id", "mention_id", "start", "end", "type", "kind", "text"), members.join(numbered, ["doc_id", "cluster"]).select("doc_id", "cluster_id", "mention_id", order.alias("place"))
