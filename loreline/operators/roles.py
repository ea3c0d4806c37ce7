"""Relations stated by possessive role nouns: 'my boss', "Dan's mother", 'Tom is her brother'. The parse is an input.

tokens: doc_id, token_id, word, tag, pos, rel, head, start, end; mentions: doc_id, mention_id (M and a number), start, end;
clusters: doc_id, cluster_id (C and a number), mention_id. What a role noun looks up is known from its neighbours in the
tree by equality joins and one interval join. Only a mention that an earlier noun brings in makes order matter, so nouns whose
reach overlaps form an island (a few words of one sentence), and each island is walked by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import spans

# Predicate, whether the possessor is its subject, and the nouns that say so.
ROLES = (
    ("WORKS_FOR", True, "boss employer manager supervisor"),
    ("WORKS_FOR", False, "employee assistant apprentice"),
    ("PARENT_OF", False, "mother mom mum father dad parent"),
    ("PARENT_OF", True, "son daughter child kid"),
    ("SIBLING_OF", True, "brother sister sibling"),
    ("MARRIED_TO", True, "wife husband spouse"),
    ("FRIEND_OF", True, "friend buddy"),
    ("ENEMY_OF", True, "enemy nemesis rival"),
    ("RELATED_TO", True, "cousin aunt uncle niece nephew"),
)
# Subjects that are nobody ('It was my boss').
IMPERSONAL = ("it", "this", "that", "there", "who", "which")

#: What a role noun looks up: its possessor, the subject that it is said of, the noun in apposition, itself without possessor.
LOOKUPS = ("owner", "subject", "apposed", "noun")


def _roles() -> Column:
    """Map of role nouns to predicate and owner_first."""
    each = [x for p, first, words in ROLES for w in words.split() for x in (F.lit(w), F.struct(F.lit(p).alias("predicate"), F.lit(first).alias("owner_first")))]
    return F.create_map(*each)


def _nouns(tokens: DataFrame) -> DataFrame:
    """Role nouns with a possessor: doc_id, place, noun, low and high (of a mention that they would bring
    in) and, for each lookup, the start and end of the token that is looked up (null: none)."""
    lower = F.lower("word")
    single = F.when((F.col("tag") == "NNS") & lower.endswith("s"), F.expr("substring(lower(word), 1, length(word) - 1)")).otherwise(lower)
    found = tokens.withColumn("noun", single).where(F.col("noun").isin(*[w for _, _, words in ROLES for w in words.split()]))
    nouns = found.select("doc_id", F.col("token_id").alias("place"), "noun", "rel", "head", F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    at = F.struct("start", "end", "pos", "word").alias("at")
    kids = tokens.where(F.col("rel").isin("poss", "appos", "nsubj")).select("doc_id", F.col("head").alias("over"), F.col("rel").alias("kid_rel"), "token_id", at)
    first = kids.groupBy("doc_id", "over", "kid_rel").agg(F.min_by("at", "token_id").alias("at"))
    child = lambda rel, name, on: first.where(F.col("kid_rel") == rel).select("doc_id", F.col("over").alias(on), F.col("at").alias(name))
    rows = nouns.join(child("poss", "owner", "place"), ["doc_id", "place"]).join(child("appos", "below", "place"), ["doc_id", "place"], "left").join(child("nsubj", "subject", "head"), ["doc_id", "head"], "left")
    above = tokens.select("doc_id", F.col("token_id").alias("head"), F.struct("start", "end").alias("above"))
    rows = rows.join(above, ["doc_id", "head"], "left")
    said_of = (F.col("rel") == "attr") & ~F.lower("subject.word").isin(*IMPERSONAL)
    place = lambda c: F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"))
    apposed = F.when(F.col("below").isNotNull(), place("below")).when(F.col("rel") == "appos", place("above"))
    return rows.select(
        "doc_id", "place", "noun", F.when(F.col("owner.pos") == "PROPN", F.col("owner.start")).otherwise(F.col("n_start")).alias("low"), F.col("n_end").alias("high"),
        place("owner").alias("owner"), F.when(said_of, place("subject")).alias("subject"), apposed.alias("apposed"), F.struct(F.col("n_start").alias("start"), F.col("n_end").alias("end")).alias("noun_at"),
    )


def role_pairs(tokens: DataFrame, mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row a relation: doc_id, place (token of the noun), noun, predicate, subject and object (mention ids), owner (the
    possessor's entity: its cluster, else its mention), and mention_id, start and end of the mention that the noun brings in (null:
    none). The holder is whom the noun is said of, else what stands in apposition, else the smallest mention of the noun without
    its possessor, else a new mention, from a possessor that is a name on. Of mentions of one size the first counts, new ones
    last. A noun whose possessor is no mention says nothing. Nothing is written on the way: tables that are dealt out alike by doc_id
    stay where they are, and only what the walk decides moves once."""
    nouns = _nouns(tokens)
    asked = nouns.select("doc_id", "place", F.col("owner.start").alias("but"), F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).alias("at")) for n, c in zip(LOOKUPS, ("owner", "subject", "apposed", "noun_at"), strict=True)])).alias("q"))
    asked = asked.where("q.at IS NOT NULL").select("doc_id", "place", "but", "q.what", "q.at.*")
    held = spans.overlapping(asked, mentions.select("doc_id", "mention_id", "start", "end"), ["doc_id"]).where("r.start <= l.start AND l.end <= r.end AND NOT (l.what = 'noun' AND r.start <= l.but AND l.but < r.end)")
    best = F.struct((F.col("r.end") - F.col("r.start")).cast("long").alias("size"), F.col("r.start").alias("first"), F.col("r.mention_id").alias("id"))
    known = held.groupBy("doc_id", F.col("l.place").alias("place")).agg(*[F.min(F.when(F.col("l.what") == n, best)).alias(f"{n}_is") for n in LOOKUPS])
    rows = nouns.join(known, ["doc_id", "place"], "left")
    reach = [c for n in ("owner", "subject", "apposed") for c in (F.col(f"{n}.start"), F.col(f"{n}.end"))]
    rows = rows.withColumns({"_from": F.least("low", *reach), "_to": F.greatest("high", *reach)})
    before = F.max("_to").over(W.partitionBy("doc_id").orderBy("_from", "place").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("_from") >= before)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(W.partitionBy("doc_id").orderBy("_from", "place")))
    fields = ["place", "noun", "low", "high", *[F.col(c).alias(f"{n}_at") for n, c in zip(LOOKUPS, ("owner", "subject", "apposed", "noun_at"), strict=True)], *[f"{n}_is" for n in LOOKUPS]]
    islands = rows.groupBy("doc_id", "_island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("nouns")).select("doc_id", "_island", "nouns")
    kind = dict(tokens.dtypes)["doc_id"]
    columns = ["doc_id", "_island", "place", "noun", "low", "high", "o", "o_new", "h", "h_new"]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(d, i, *r) for d, i, nouns in f.itertuples(index=False) for r in _walk(nouns)], columns=columns)

    decided = islands.mapInPandas(run, f"doc_id {kind}, _island long, place int, noun string, low {dict(nouns.dtypes)['low']}, high {dict(nouns.dtypes)['high']}, o string, o_new int, h string, h_new int")
    number = lambda c: F.substring(c, 2, 18).cast("long")
    last = mentions.groupBy("doc_id").agg(F.max(number(F.col("mention_id"))).alias("last"))
    out = decided.join(last, "doc_id", "left").withColumn("fresh", F.coalesce(F.col("h_new") == F.col("place"), F.lit(False)))
    nth = F.sum(F.col("fresh").cast("long")).over(W.partitionBy("doc_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("_id", F.when(F.col("fresh"), F.concat(F.lit("M"), F.coalesce("last", F.lit(0)) + nth)))
    # an end is brought in by a noun of the same island
    made = F.collect_list(F.when(F.col("fresh"), F.struct("place", F.col("_id").alias("id")))).over(W.partitionBy("doc_id", "_island"))
    by = lambda c: F.get(F.filter("_made", lambda m: m["place"] == F.col(c)), F.lit(0))["id"]
    out = out.withColumn("_made", made).withColumns({"o": F.coalesce("o", by("o_new")), "h": F.coalesce("h", by("h_new"))}).drop("_made")
    out = out.join(clusters.groupBy("doc_id", F.col("mention_id").alias("o")).agg(F.min("cluster_id").alias("c")), ["doc_id", "o"], "left")
    out = out.withColumn("role", F.element_at(_roles(), F.col("noun"))).select("*", "role.*")
    new = lambda c: F.when(F.col("fresh"), F.col(c))
    subject, obj = F.when(F.col("owner_first"), F.col("o")).otherwise(F.col("h")), F.when(F.col("owner_first"), F.col("h")).otherwise(F.col("o"))
    return out.select("doc_id", "place", "noun", "predicate", subject.alias("subject"), obj.alias("object"), F.coalesce("c", "o").alias("owner"), new("h").alias("mention_id"), new("low").alias("start"), new("high").alias("end"))


def _walk(nouns: list) -> list[tuple]:
    """place, noun, low, high, possessor and holder of the nouns of one island in order; each end is a known mention or the noun that brought it in."""
    made: list[tuple[int, int, int]] = []
    out = []
    for n in nouns:

        def smallest(what: str, but: int | None = None, n=n) -> tuple[str | None, int | None] | None:
            at, best = n[f"{what}_at"], n[f"{what}_is"]
            if at is None:
                return None
            own = [(hi - lo, by) for lo, hi, by in made if lo <= at["start"] and at["end"] <= hi and not (but is not None and lo <= but < hi)]
            if own and (best is None or min(own)[0] < best["size"]):
                return None, min(own)[1]
            return None if best is None else (best["id"], None)

        owner = smallest("owner")
        if owner is None:
            continue
        holder = smallest("subject") or smallest("apposed") or smallest("noun", n["owner_at"]["start"])
        if holder is None:
            made.append((n["low"], n["high"], n["place"]))
            holder = None, n["place"]
        out.append((n["place"], n["noun"], n["low"], n["high"], *owner, *holder))
    return out


def role_mentions(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The mentions that role_pairs brings in, as mentions: doc_id, mention_id, text, type, kind, start, end. texts: doc_id, text."""
    rows = found.where("mention_id IS NOT NULL").join(texts.select("doc_id", F.col("text").alias("_t")), "doc_id")
    return rows.select("doc_id", "mention_id", F.expr("substring(_t, start + 1, end - start)").alias("text"), F.lit("character").alias("type"), F.lit("nominal").alias("kind"), "start", "end")


def with_clusters(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """found of role_pairs with cluster_id: new mentions are one person if noun and possessor's entity are the same. Numbered on from
    the document's last cluster, in order of the first of each; one alone is no cluster (null), nor is a known mention."""
    fresh = F.col("mention_id").isNotNull()
    one = W.partitionBy("doc_id", "noun", "owner")
    last = clusters.groupBy("doc_id").agg(F.max(F.substring("cluster_id", 2, 18).cast("long")).alias("_last"))
    rows = found.withColumns({"_in": fresh & (F.count_if(fresh).over(one) > 1), "_first": F.min(F.when(fresh, F.col("place"))).over(one)}).join(last, "doc_id", "left")
    rank = F.dense_rank().over(W.partitionBy("doc_id", "_in").orderBy("_first"))
    return rows.withColumn("cluster_id", F.when(F.col("_in"), F.concat(F.lit("C"), F.coalesce("_last", F.lit(0)) + rank))).drop("_in", "_first", "_last")


def role_clusters(found: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, cluster_id, mention_id of the new clusters of with_clusters."""
    return with_clusters(found, clusters).where("cluster_id IS NOT NULL").select("doc_id", "cluster_id", "mention_id")
