"""From annotation documents to the rows that a chapter's integration takes. Tables are keyed by story_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.functions import vocabulary as V
from loreline.operators import texts, views
from loreline.operators.documents import KEY, part
from loreline.sources.shared import settled

#: What becomes an entity, and events that tell nothing.
ENTITY_TYPES = ("character", "location", "organization")
UNTOLD = ("OTHER",)


@dataclass(frozen=True)
class Rows:
    """What `integrate.integrate_chapter` takes, for many stories at once; `of` picks one."""

    entities: DataFrame
    relations: DataFrame
    events: DataFrame
    temporal: DataFrame
    evidence: DataFrame

    def of(self, story: str) -> Rows:
        return Rows(*[t.where(F.col(KEY) == story).drop(KEY) for t in (self.entities, self.relations, self.events, self.temporal, self.evidence)])


def groups(documents: DataFrame) -> DataFrame:
    """Mentions with the group they belong to: story_id, mention_id, text, type, mention_kind, place, entity (cluster, or the
    mention itself) and at, the group's and the mention's place: clusters come first, each in its own order. A mention that
    two clusters list belongs to the first; a cluster that lists nothing known makes no group."""
    listed = part(documents, "coreference_clusters").select(KEY, F.col("place").alias("c"), "cluster_id", F.posexplode("mentions").alias("n", "mention_id"))
    home = listed.groupBy(KEY, "mention_id").agg(F.min(F.struct("c", "n", "cluster_id")).alias("h"))
    m = part(documents, "mentions").select(KEY, "mention_id", "text", "type", "mention_kind", "place").join(home, [KEY, "mention_id"], "left")
    outside = F.col("h").isNull()
    at = F.struct(outside.alias("outside"), F.coalesce("h.c", "place").alias("group"), F.coalesce("h.n", F.lit(0)).alias("nth"))
    return m.select(KEY, "mention_id", "text", "type", "mention_kind", F.coalesce("h.cluster_id", "mention_id").alias("entity"), at.alias("at"))


def _gendered(word: Column, words: tuple[str, ...]) -> Column:
    return word.isin(*words).cast("int")


def genders(members: DataFrame) -> DataFrame:
    """story_id, entity, gender (m, f or null): role words and titles at the ends of names decide, else pronouns."""
    words = F.transform(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "), lambda w: F.lower(F.regexp_replace(w, "^[.,'’]+|[.,'’]+$", "")))
    rows = members.select(KEY, "entity", words.alias("w"))
    first, last = F.col("w")[0], F.element_at("w", -1)
    alone = (F.size("w") == 1) & first.isin(*V.GENDER_PRONOUNS["m"], *V.GENDER_PRONOUNS["f"])
    counts = []
    for g in ("m", "f"):
        named = F.when(alone, 0).otherwise(_gendered(first, V.GENDER_ROLES[g]) + _gendered(last, V.GENDER_ROLES[g]))
        counts += [F.sum(named).alias(f"role_{g}"), F.sum(F.when(alone, _gendered(first, V.GENDER_PRONOUNS[g])).otherwise(0)).alias(f"pronoun_{g}")]
    sums = rows.groupBy(KEY, "entity").agg(*counts)
    by_role = S.group_gender(F.col("role_m"), F.col("role_f"), F.lit(0), F.lit(0))
    by_pronoun = S.group_gender(F.lit(0), F.lit(0), F.col("pronoun_m"), F.col("pronoun_f"))
    return sums.select(KEY, "entity", F.coalesce(by_role, by_pronoun).alias("gender"))


def _ends(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Relationships between groups: story_id, place, s, predicate, o."""
    of = members.select(KEY, "mention_id", "entity")
    rows = part(documents, "relationships").select(KEY, "place", "predicate", "subject_mention_id", "object_mention_id")
    for ref, to in (("subject_mention_id", "s"), ("object_mention_id", "o")):
        rows = rows.join(of.select(KEY, F.col("mention_id").alias(ref), F.col("entity").alias(to)), [KEY, ref])
    return rows.select(KEY, "place", "s", "predicate", "o")


def named_groups(members: DataFrame, about: DataFrame) -> DataFrame:
    """story_id, entity, at, type, name and proper (its proper names; empty for a group that only a noun names).

    A group is named by its most frequent proper name, of equals the shorter, then the first. Groups in about (story_id, entity)
    may go by their most frequent noun, unless it tells of several. Types that are no entities and groups without a name go.
    """
    texts_of = members.groupBy(KEY, "entity", "mention_kind", "text").agg(F.count("*").alias("n"), F.min("at").alias("seen"))
    order = F.struct(-F.col("n"), F.length("text"), F.col("seen"))
    best = lambda kind: F.min_by(F.when(F.col("mention_kind") == kind, F.col("text")), F.when(F.col("mention_kind") == kind, order))
    proper = F.array_sort(F.collect_set(F.when(F.col("mention_kind") == "proper", F.col("text"))))
    names = texts_of.groupBy(KEY, "entity").agg(best("proper").alias("p"), best("nominal").alias("q"), proper.alias("proper"))
    types = members.groupBy(KEY, "entity", "type").agg(F.count("*").alias("n"), F.min("at").alias("seen"))
    kinds = types.groupBy(KEY, "entity").agg(F.min_by("type", F.struct(-F.col("n"), F.col("seen"))).alias("type"), F.min("seen").alias("at"))
    told = about.select(KEY, "entity").distinct().withColumn("told", F.lit(True))
    rows = names.join(kinds, [KEY, "entity"]).join(told, [KEY, "entity"], "left").where(F.col("type").isin(*ENTITY_TYPES))
    noun = F.when(F.col("told") & ~S.names_several(F.col("q")), F.col("q"))
    return rows.select(KEY, "entity", "at", "type", F.coalesce("p", noun).alias("name"), "proper").where("name IS NOT NULL")


def owned_roles(named: DataFrame, ends: DataFrame) -> DataFrame:
    """named, where a group that only a noun names is called after the first properly named group that it is related to
    ("wife" becomes "Mr. Vane's wife"), unless it names an owner already."""
    one = lambda role, owner, side: ends.select(KEY, F.col(role).alias("entity"), F.col(owner).alias("owner"), F.struct("place", F.lit(side).alias("side")).alias("rank"))
    owners = named.where(F.size("proper") > 0).select(KEY, F.col("entity").alias("owner"), F.col("name").alias("owner_name"))
    roles = named.where((F.size("proper") == 0) & ~F.contains("name", F.lit("'s "))).select(KEY, "entity")
    first = one("s", "o", 0).unionByName(one("o", "s", 1)).join(owners, [KEY, "owner"]).join(roles, [KEY, "entity"], "left_semi").groupBy(KEY, "entity").agg(F.min_by("owner_name", "rank").alias("owner"))
    name = F.when(F.col("owner").isNotNull(), F.concat("owner", F.lit("'s "), S.without_determiner(F.col("name")))).otherwise(F.col("name"))
    return named.join(first, [KEY, "entity"], "left").withColumn("name", name).drop("owner")


def rows_of(documents: DataFrame) -> Rows:
    """Documents (schema DOCUMENT, with or without temporal_relations) as entities, relations, events, temporal and evidence.

    Groups of one name are one entity, placed and typed as the first. A noun that names nobody stays only with a fact or a
    relation to another that stays. A property has the first value told, a parent the predicate of its gender, an event
    its sentence on one line; relations and participants are told once. A name's evidence is the gender of its groups if all
    agree. Null arrays count as empty; references to unknown mentions are left out; documents without entities give no rows. Steps that several tables need are checkpointed, once each.
    """
    members = settled(groups(documents))
    ends = settled(_ends(documents, members))
    facts = part(documents, "facts").withColumnRenamed("entity_mention_id", "mention_id").join(members.select(KEY, "mention_id", "entity"), [KEY, "mention_id"]).select(KEY, "place", "entity", "property", "value")
    told = facts.select(KEY, "entity").unionByName(ends.select(KEY, F.col("s").alias("entity"))).unionByName(ends.select(KEY, F.col("o").alias("entity")))
    named = settled(owned_roles(named_groups(members, told), ends))
    of = named.select(KEY, "entity", "name")
    both = ends.join(of.select(KEY, F.col("entity").alias("s"), F.col("name").alias("subject")), [KEY, "s"]).join(of.select(KEY, F.col("entity").alias("o"), F.col("name").alias("object")), [KEY, "o"])
    tied = facts.select(KEY, "entity").unionByName(both.select(KEY, F.col("s").alias("entity"))).unionByName(both.select(KEY, F.col("o").alias("entity"))).distinct().withColumn("tied", F.lit(True))
    kept = settled(named.join(tied, [KEY, "entity"], "left").where((F.size("proper") > 0) | F.col("tied")).drop("tied"))
    of = kept.select(KEY, "entity", "name")

    attributes = facts.join(of, [KEY, "entity"]).groupBy(KEY, "name", "property").agg(F.min_by("value", "place").alias("value"))
    attributes = attributes.groupBy(KEY, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("attributes"))
    merged = kept.groupBy(KEY, "name").agg(F.min("at").alias("at"), F.min_by("type", "at").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("proper")))).alias("proper"))
    numbered = merged.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("at", "name", "type", "proper"))).alias("all")).select(KEY, F.posexplode("all").alias("place", "e"))
    entities = numbered.select(KEY, "place", "e.name", "e.type", F.array_remove("e.proper", F.col("e.name")).alias("aliases")).join(attributes, [KEY, "name"], "left")
    entities = entities.select(KEY, "place", "name", "type", "aliases", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.col("name").alias("mention"))

    gender = settled(genders(members))
    related = both.join(gender.withColumnRenamed("entity", "s"), [KEY, "s"], "left").withColumn("predicate", S.parent_predicate(F.col("predicate"), F.col("gender")))
    relations = related.groupBy(KEY, "subject", "predicate", "object").agg(F.min("place").alias("place"))

    events = part(documents, "events").where(F.coalesce("type", F.lit("")).isin(*UNTOLD) == F.lit(False))
    took = events.select(KEY, "event_id", F.posexplode("participants").alias("nth", "p")).select(KEY, "event_id", "nth", F.col("p.mention_id").alias("mention_id"), F.upper("p.role").alias("role"))
    took = took.join(members.select(KEY, "mention_id", "entity"), [KEY, "mention_id"]).join(of, [KEY, "entity"]).groupBy(KEY, "event_id", "name", "role").agg(F.min("nth").alias("nth"))
    took = took.groupBy(KEY, "event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name", "role"))), lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"))).alias("participants"))
    said = views.sentence_at(events.select(KEY, F.col("start").alias("at")).distinct(), texts.sentences(documents, KEY, "text"), KEY)
    placed = events.select(KEY, "event_id", "type", F.col("start").alias("at")).join(said.withColumnRenamed("text", "description"), [KEY, "at"], "left").join(took, [KEY, "event_id"], "left")
    nobody = F.array().cast("array<struct<name:string,role:string>>")
    events = placed.select(KEY, F.col("event_id").alias("id"), "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("participants", nobody).alias("participants"))

    known = events.select(KEY, "id")
    if "temporal_relations" in documents.columns:
        temporal = part(documents, "temporal_relations").select(KEY, F.col("source_event_id").alias("event_1"), "relation", F.col("target_event_id").alias("event_2"))
    else:
        temporal = known.select(KEY, F.col("id").alias("event_1"), F.lit("").alias("relation"), F.col("id").alias("event_2")).where(F.lit(False))
    for end in ("event_1", "event_2"):
        temporal = temporal.join(known.withColumnRenamed("id", end), [KEY, end], "left_semi")

    clues = kept.join(gender, [KEY, "entity"], "left").groupBy(KEY, F.lower(F.trim("name")).alias("name")).agg(F.collect_set(F.coalesce("gender", F.lit("unknown"))).alias("g"))
    evidence = clues.select(KEY, "name", F.when((F.size("g") == 1) & (F.col("g")[0] != "unknown"), F.col("g")[0]).alias("gender"))
    return Rows(entities, relations.select(KEY, "place", "subject", "predicate", "object"), events, temporal.select(KEY, "event_1", "relation", "event_2"), evidence)
