"""Mentions, coreference, events and temporal relations from span and token tables. Models are inputs, never run here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import spans

# Event types by verb, and words that decide on roles and relations.
VERBS = {
    "CONVERSATION": "say tell ask answer reply respond speak talk call shout yell scream whisper mumble mutter croak chat ring announce explain",
    "TRAVEL": "walk drive travel ride wander climb cross hike",
    "ARRIVAL": "arrive reach enter",
    "DEPARTURE": "leave depart exit",
    "MEETING": "meet greet visit",
    "DISCOVERY": "find discover notice realize spot",
    "ATTACK": "attack hit strike stab shoot punch slap kick",
    "DEATH": "die drown perish",
    "CONFLICT": "fight argue struggle",
    "CREATION": "build create",
    "DESTRUCTION": "destroy break smash shatter demolish",
}
PLACE_WORDS = "in into on onto at through to from out inside across along up down under over toward towards behind near".split()
DEATH_WORDS = ("dead", "deceased")
MARKERS = {"before": "BEFORE", "until": "BEFORE", "after": "AFTER", "while": "DURING"}


def build_mentions(found: DataFrame, threshold: float = 0.0) -> DataFrame:
    """found (doc_id, start, end, type, confidence, kind, seen) to one mention a span: the most confident type, of equals the
    first seen; pronouns dropped; numbered M1, M2, ... in text order."""
    best = found.where(F.col("confidence") >= threshold).groupBy("doc_id", "start", "end").agg(F.max_by(F.struct("type", "kind"), F.struct("confidence", -F.col("seen"))).alias("b"))
    kept = best.where("b.kind <> 'pronominal'")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("start", "end"))
    return kept.select("doc_id", F.concat(F.lit("M"), n).alias("mention_id"), "start", "end", "b.type", "b.kind")


def cluster_spans(members: DataFrame, tokens: DataFrame) -> DataFrame:
    """members (doc_id, cluster, start_token, end_token) as arrays of character spans: doc_id, cluster, spans."""
    a = tokens.select("doc_id", F.col("token_id").alias("start_token"), "start")
    b = tokens.select("doc_id", F.col("token_id").alias("end_token"), "end")
    rows = members.join(a, ["doc_id", "start_token"]).join(b, ["doc_id", "end_token"])
    return rows.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def merge_clusters(mentions: DataFrame, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, mention_id, cluster_id: mentions joined by clusters (doc_id, mention_id, cluster), by links (doc_id, a, b) and, but
    for pronouns, by equal folded text and type. Clusters of one are left out; C1, C2, ... in order of first mention."""
    edges = clusters.join(clusters.groupBy("doc_id", "cluster").agg(F.min("mention_id").alias("b")), ["doc_id", "cluster"]).select("doc_id", F.col("mention_id").alias("a"), "b").unionByName(links.select("doc_id", "a", "b"))
    same = mentions.where("kind <> 'pronominal'").withColumn("f", S.fold_spaces(F.col("text")))
    edges = edges.unionByName(same.join(same.groupBy("doc_id", "f", "type").agg(F.min("mention_id").alias("b")), ["doc_id", "f", "type"]).select("doc_id", F.col("mention_id").alias("a"), "b"))
    grouped = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "mention_id"))).alias("m")).join(edges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("e")), "doc_id", "left")

    def one(order: list, pairs: list) -> list[tuple[str, str]]:
        up = {r["mention_id"]: r["mention_id"] for r in order}

        def top(x: str) -> str:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for p in pairs if pairs is not None else ():
            if p["a"] in up and p["b"] in up:
                up[top(p["a"])] = top(p["b"])
        sets: dict[str, list[str]] = {}
        for m in up:
            sets.setdefault(top(m), []).append(m)
        return [(m, f"C{n}") for n, s in enumerate((s for s in sets.values() if len(s) > 1), 1) for m in s]

    def run(frames):
        for f in frames:
            rows = [(d, m, c) for d, o, e in f.itertuples(index=False) for m, c in one(o, e)]
            yield pd.DataFrame(rows, columns=["doc_id", "mention_id", "cluster_id"])

    kinds = dict(mentions.dtypes)
    return grouped.mapInPandas(run, f"doc_id {kinds['doc_id']}, mention_id string, cluster_id string")


def with_singletons(mentions: DataFrame, clustered: DataFrame) -> DataFrame:
    """doc_id, mention_id, entity: the cluster of a mention, or the mention itself."""
    return mentions.select("doc_id", "mention_id").join(clustered, ["doc_id", "mention_id"], "left").select("doc_id", "mention_id", F.coalesce("cluster_id", "mention_id").alias("entity"))


def conjunct_heads(tokens: DataFrame) -> DataFrame:
    """doc_id, token_id, root: the token that a chain of conjuncts starts from; tokens that are no conjunct are their own. Only
    conjuncts go to Python."""
    chained = tokens.where("rel = 'conj'")
    grouped = chained.groupBy("doc_id").agg(F.collect_list(F.struct("token_id", "head")).alias("t"))

    def run(frames):
        for f in frames:
            rows = []
            for d, toks in f.itertuples(index=False):
                up = {t["token_id"]: t["head"] for t in toks}
                for t in toks:
                    x, seen = t["token_id"], set()
                    while x in up and x not in seen:
                        seen.add(x)
                        x = up[x]
                    rows.append((d, t["token_id"], x))
            yield pd.DataFrame(rows, columns=["doc_id", "token_id", "root"])

    roots = grouped.mapInPandas(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, token_id int, root int")
    own = tokens.where("rel IS NULL OR rel <> 'conj'").select("doc_id", F.col("token_id").cast("int").alias("token_id"), F.col("token_id").cast("int").alias("root"))
    return own.unionByName(roots)


def find_events(tokens: DataFrame) -> DataFrame:
    """doc_id, token_id, type, start, end, word: verbs marked as events by type (nothing said is no conversation), and 'X was
    dead' unless denied. tokens: doc_id, token_id, word, lemma, pos, rel, head, start, end, event (boolean)."""
    type_of = {v: k for k, words in VERBS.items() for v in words.split()}
    lookup = F.create_map(*[F.lit(x) for kv in type_of.items() for x in kv])
    lemma = F.lower("lemma")
    silent = tokens.where((F.lower("lemma") == "nothing") & (F.col("rel") == "dobj")).select("doc_id", F.col("head").alias("token_id")).distinct().withColumn("silent", F.lit(True))
    verbs = tokens.where(F.col("event") & (F.col("pos") == "VERB")).join(silent, ["doc_id", "token_id"], "left")
    kind = F.coalesce(F.element_at(lookup, lemma), F.lit("OTHER"))
    verbs = verbs.withColumn("type", F.when((kind == "CONVERSATION") & F.col("silent"), "OTHER").otherwise(kind))
    denied = tokens.where("rel = 'neg'").select("doc_id", "head").distinct()
    dead = tokens.where(lemma.isin(*DEATH_WORDS) & (F.col("rel") == "acomp") & ~(F.col("event") & (F.col("pos") == "VERB"))).join(denied, ["doc_id", "head"], "left_anti").withColumn("type", F.lit("DEATH"))
    cols = ["doc_id", "token_id", "type", "start", "end", "word", "rel", "head", "lemma"]
    return verbs.select(*cols).unionByName(dead.select(*cols))


def participants(events: DataFrame, tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, token_id (of the event), role, mention_id. Subjects, else those of the verb that the event is coordinated with,
    objects, recipients and places after a preposition, each with its conjuncts; the smallest mention that holds the word. A
    character at a place is a participant, after 'to' a recipient if it is spoken to."""
    kids = tokens.select("doc_id", F.col("head").alias("h"), F.col("token_id").alias("k"), F.col("rel").alias("k_rel"), F.lower("lemma").alias("k_lemma"))
    ev = events.select("doc_id", F.col("token_id").alias("e"), "rel", "head", "lemma", "type")
    at = lambda on: ev.join(kids, (ev["doc_id"] == kids["doc_id"]) & (kids["h"] == on)).drop(kids["doc_id"])
    own = at(ev["e"])
    subjects = own.where(F.col("k_rel").isin("nsubj", "nsubjpass")).select("doc_id", "e", F.when(F.col("k_rel") == "nsubjpass", "patient").otherwise("agent").alias("role"), "k")
    shared = at(ev["head"]).where("rel = 'conj' AND k_rel = 'nsubj'").select("doc_id", "e", F.lit("agent").alias("role"), "k").join(subjects.select("doc_id", "e"), ["doc_id", "e"], "left_anti")
    objects = own.where(F.col("k_rel").isin("dobj", "dative")).select("doc_id", "e", F.when(F.col("k_rel") == "dobj", "patient").otherwise("recipient").alias("role"), "k")
    preps = own.where((F.col("k_rel") == "prep") & F.col("k_lemma").isin(*PLACE_WORDS)).select("doc_id", "e", F.col("k").alias("p"), "k_lemma")
    inner = kids.where("k_rel = 'pobj'").select("doc_id", F.col("h").alias("p"), "k")
    places = preps.join(inner, ["doc_id", "p"]).select("doc_id", "e", F.lit("location").alias("role"), "k", (F.col("k_lemma") == "to").alias("to"))
    every = subjects.unionByName(shared).unionByName(objects).withColumn("to", F.lit(False)).unionByName(places)
    heads = conjunct_heads(tokens).select("doc_id", F.col("root").alias("k"), F.col("token_id").alias("word"))
    every = every.join(heads, ["doc_id", "k"])
    words = tokens.select("doc_id", F.col("token_id").alias("word"), "start", "end")
    holders = spans.containing(words, mentions, ["doc_id"], "word").select("doc_id", "word", F.col("r.mention_id").alias("mention_id"), F.col("r.type").alias("m_type"))
    rows = every.join(holders, ["doc_id", "word"]).join(ev.select("doc_id", "e", F.col("type").alias("e_type")), ["doc_id", "e"])
    person = (F.col("role") == "location") & (F.col("m_type") == "character")
    role = F.when(person & F.col("to") & (F.col("e_type") == "CONVERSATION"), "recipient").when(person & ~F.col("to"), "participant").otherwise(F.col("role"))
    return rows.select("doc_id", F.col("e").alias("token_id"), role.alias("role"), "mention_id").distinct()


def temporal_relations(events: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, source, relation, target (token ids of events): a clause under before, until, after or while, and the event it hangs on."""
    marks = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    ids = events.select("doc_id", F.col("token_id").alias("target"), "rel", "head")
    kids = tokens.where("rel = 'mark'").select("doc_id", F.col("head").alias("target"), F.element_at(marks, F.lower("lemma")).alias("relation"), F.col("token_id").alias("place")).where("relation IS NOT NULL")
    first = kids.groupBy("doc_id", "target").agg(F.min_by("relation", "place").alias("relation"))
    clauses = ids.where("rel = 'advcl'").join(first, ["doc_id", "target"]).select("doc_id", "target", F.col("head").alias("source"), "relation")
    above = tokens.select("doc_id", F.col("token_id").alias("head"), F.col("head").alias("source"), F.element_at(marks, F.lower("lemma")).alias("relation"))
    after = ids.where("rel = 'pcomp'").join(above, ["doc_id", "head"]).where("relation IS NOT NULL").select("doc_id", "target", "source", "relation")
    known = events.select("doc_id", F.col("token_id").alias("source"))
    return clauses.unionByName(after).where("source <> target").join(known, ["doc_id", "source"], "left_semi").select("doc_id", "source", "relation", "target")


def representatives(mentions: DataFrame, near: DataFrame) -> DataFrame:
    """For each (doc_id, entity, low, high) of near the mention that stands for the entity there: a proper name in the stretch,
    else a nominal one, else the same anywhere, else any. mentions: doc_id, entity, mention_id, kind, start."""
    rows = near.join(mentions, ["doc_id", "entity"])
    here = (F.col("start") >= F.col("low")) & (F.col("start") < F.col("high"))
    proper, nominal = F.col("kind") == "proper", F.col("kind") == "nominal"
    rank = F.when(here & proper, 0).when(here & nominal, 1).when(proper, 2).when(nominal, 3).when(here, 4).otherwise(5)
    return rows.groupBy("doc_id", "entity", "low", "high").agg(F.min_by("mention_id", F.struct(rank, "start")).alias("mention_id"))


def keep_relations(found: DataFrame, types: tuple[str, ...] = ("character", "organization")) -> DataFrame:
    """found (doc_id, source, s_type, predicate, target, t_type, place): relations between two entities of the types, each
    once in its canonical form, the first found."""
    good = found.where((F.col("source") != F.col("target")) & F.col("s_type").isin(*types) & F.col("t_type").isin(*types))
    keyed = good.withColumn("_c", S.canonical_relation(F.col("source"), F.col("predicate"), F.col("target")))
    return keyed.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "_c").orderBy("place"))).where("_r = 1").drop("_c", "_r")
