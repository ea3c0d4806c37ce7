"""The write side: chapters of extracted entities, facts, relationships and events are folded into the world in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.functions import vocabulary as V
from loreline.operators import ledger, resolve, rules
from loreline.sources.shared import plain_unions, settled


@dataclass(frozen=True)
class State:
    """Tables of a world. entities: id, canonical_name, entity_type; aliases: entity_id, alias; facts: version_id, entity_id,
    property_name, value, chapter_number, created_at, status; relations: version_id, source_id, target_id,
    relationship_type, chapter_number, created_at, status; events: event_id, chapter_number, event_type, description;
    participants: event_id, entity_id, role; mentions: mention_id, entity_id, surface_text, chapter_number; contradictions:
    contradiction_id, rule_id, old_version_id, new_version_id, event_refs, signature, confidence, status, chapter_number.
    created_at counts up in the order of writes."""

    entities: DataFrame
    aliases: DataFrame
    facts: DataFrame
    relations: DataFrame
    events: DataFrame
    participants: DataFrame
    mentions: DataFrame
    contradictions: DataFrame


def ident(*parts: Column) -> Column:
    """An id that depends on its parts alone, so that repeating a write makes no second row."""
    return F.sha2(F.concat_ws("\u0001", *[p.cast("string") for p in parts]), 256)


_FINDING = ["version_id", "rule_id", "old_version_id", "old_value", "confidence"]


def _found(rows: DataFrame, rules_of: list[tuple[str, float, Column, Column]]) -> DataFrame:
    """A row of _FINDING for each rule (name, confidence, condition, the version it speaks against: id and value) that holds."""
    hits = F.array(*[F.when(holds, F.struct(F.lit(name).alias("rule_id"), old["id"].alias("old_version_id"), old["value"].alias("old_value"), F.lit(sure).alias("confidence"))) for name, sure, holds, old in rules_of])
    return rows.select("version_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("f")).select("version_id", "f.*")


def fact_findings(new: DataFrame, stored: DataFrame) -> DataFrame:
    """What the stored versions of the same entity and property say against each new one: another value of an immutable
    property than the last ACTIVE one; an age under that of the nearest earlier chapter or over that of the nearest later
    one; alive after a chapter that says dead, or dead before one that says alive. Ages and states count in ACTIVE and
    SUPERSEDED versions that have a chapter, and never within one chapter."""
    key = ["entity_id", "property_name"]
    old = stored.select(*key, F.struct(F.col("version_id").alias("id"), "value").alias("o"), F.col("status").alias("o_status"), F.col("chapter_number").alias("o_chapter"), F.struct("created_at", "version_id").alias("o_at"))
    place = F.struct("o_chapter", "o_at")
    accepted = F.col("o_status").isin("ACTIVE", "SUPERSEDED") & F.col("o_chapter").isNotNull()
    earlier, later = accepted & (F.col("o_chapter") < F.col("chapter_number")), accepted & (F.col("o_chapter") > F.col("chapter_number"))
    age, life = S.parse_age(F.col("o.value")), S.life_state(F.col("o.value"))
    last = lambda holds, order: F.max_by("o", F.when(holds, order))
    first = lambda holds, order: F.min_by("o", F.when(holds, order))
    seen = new.join(old, key).groupBy("version_id", "property_name", "value").agg(
        last((F.col("o_status") == "ACTIVE") & ~S.is_blank(F.col("o.value")), F.col("o_at")).alias("active"),
        last(earlier & age.isNotNull(), place).alias("age_before"), first(later & age.isNotNull(), place).alias("age_after"),
        last(earlier & (life == "DEAD"), place).alias("dead"), first(later & (life == "ALIVE"), place).alias("alive"),
    )
    name, mine = S.normalize_property(F.col("property_name")), S.parse_age(F.col("value"))
    return _found(seen, [
        ("IMMUTABLE_FACT", 0.9, (S.property_kind(name) == "immutable") & F.col("active").isNotNull() & ~S.values_equal(F.col("active.value"), F.col("value")), F.col("active")),
        ("AGE_MONOTONIC", 0.7, (name == "age") & (mine < S.parse_age(F.col("age_before.value"))), F.col("age_before")),
        ("AGE_MONOTONIC", 0.7, (name == "age") & (mine > S.parse_age(F.col("age_after.value"))), F.col("age_after")),
        ("DEAD_THEN_ALIVE", 0.7, (name == "status") & (S.life_state(F.col("value")) == "ALIVE") & F.col("dead").isNotNull(), F.col("dead")),
        ("DEAD_THEN_ALIVE", 0.7, (name == "status") & (S.life_state(F.col("value")) == "DEAD") & F.col("alive").isNotNull(), F.col("alive")),
    ])


def relation_findings(new: DataFrame, stored: DataFrame) -> DataFrame:
    """What stored versions say against each new one: a type incompatible with the pair's last ACTIVE one, and for types of
    a single source another source of the same target that is ACTIVE (the last such)."""
    kind = lambda c: S.normalize_predicate(F.col(c))
    at, o = F.struct("created_at", "version_id").alias("o_at"), F.struct(F.col("version_id").alias("id"), F.col("relationship_type").alias("value")).alias("o")
    active = stored.where("status = 'ACTIVE'")
    pair = new.join(active.select("source_id", "target_id", o, at), ["source_id", "target_id"]).groupBy("version_id", "relationship_type").agg(F.max_by("o", "o_at").alias("last"))
    low, high = F.least(kind("last.value"), kind("relationship_type")), F.greatest(kind("last.value"), kind("relationship_type"))
    clash = F.lit(False)
    for a, b in V.INCOMPATIBLE_PREDICATES:
        clash = clash | ((low == min(a, b)) & (high == max(a, b)))
    single = new.where(kind("relationship_type").isin(*V.SINGLE_SOURCE_PREDICATES)).select("version_id", "source_id", "target_id", kind("relationship_type").alias("kind"))
    other = active.select(F.col("source_id").alias("o_source"), "target_id", kind("relationship_type").alias("kind"), o, at)
    incoming = single.join(other, ["target_id", "kind"]).where("o_source <> source_id").groupBy("version_id").agg(F.max_by("o", "o_at").alias("last"))
    return _found(pair, [("RELATIONSHIP_INCOMPATIBLE", 0.85, clash, F.col("last"))]).unionByName(_found(incoming, [("RELATIONSHIP_SINGLE_SOURCE", 0.6, F.lit(True), F.col("last"))]))


def append(stored: DataFrame, fresh: DataFrame, key: list[str], group: Column, same: Callable[[str, str], Column], findings: Callable[[DataFrame, DataFrame], DataFrame], reach: list[str]) -> tuple[DataFrame, DataFrame]:
    """stored with the versions of fresh written one after the other, and what the rules found.

    A version against which something is found is CONTRADICTED and leaves the others alone; a clean one is ACTIVE and
    supersedes the newest ACTIVE version of its key if that differs (same: names of the two value columns). Only versions
    of one group can matter to each other: the k-th of every group are written at once, in as many rounds as the
    largest group of this chapter has versions. Stored versions that agree with no fresh one in reach (columns) are set apart once
    and neither judged nor written again.
    """
    plain_unions(stored.sparkSession)
    fresh = fresh.join(stored.select("version_id"), "version_id", "left_anti")
    fresh = settled(fresh.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy("created_at", "version_id"))))
    names, found = stored.columns, None
    near = fresh.select(*reach).distinct()
    rest, stored = stored.join(near, reach, "left_anti").select(names), settled(stored.join(near, reach, "left_semi").select(names))
    for turn in range(1, (fresh.agg(F.max("turn")).first()[0] or 0) + 1):
        new = fresh.where(F.col("turn") == turn).drop("turn")
        hits = settled(findings(new, stored))
        bad = hits.select("version_id").distinct().withColumn("bad", F.lit(True))
        new = new.join(bad, "version_id", "left").withColumn("status", F.when(F.col("bad"), "CONTRADICTED").otherwise("ACTIVE")).drop("bad")
        newest = F.max_by(F.struct("version_id", F.col(_value(names)).alias("was")), F.struct("created_at", "version_id")).alias("top")
        now = stored.where("status = 'ACTIVE'").join(new.where("status = 'ACTIVE'").select(*key).distinct(), key, "left_semi").groupBy(*key).agg(newest)
        gone = new.where("status = 'ACTIVE'").join(now, key).withColumn("was", F.col("top.was")).where(~same("was", _value(names))).select(F.col("top.version_id").alias("version_id")).distinct().withColumn("gone", F.lit(True))
        stored = stored.join(gone, "version_id", "left").withColumn("status", F.when(F.col("gone"), "SUPERSEDED").otherwise(F.col("status"))).select(names)
        stored = settled(stored.unionByName(new.select(names)))
        found = hits if found is None else found.unionByName(hits)
    return rest.unionByName(stored), found if found is not None else findings(fresh.drop("turn").limit(0), stored)


def _value(names: list[str]) -> str:
    return "value" if "value" in names else "relationship_type"


def integrate_chapter(state: State, chapter: int, entities: DataFrame, relations: DataFrame, events: DataFrame, world: str = "", temporal: DataFrame | None = None, evidence: DataFrame | None = None) -> State:
    """The state after one chapter. entities: place, name, type, aliases array<string>, attributes map<string,string>, and
    mention where there is one; relations: place, subject, predicate, object (names); events: type, description, and where
    there are such, id and participants array<struct<name,role>>; temporal: event_1, relation, event_2 (ids of these
    events); evidence: name, gender, which can veto an identity.

    Names resolve to entities stored before the chapter; the others are created, one for each folded name. A role that a
    proper name reaches is renamed, its old name becomes an alias. Versions are written in the order of their places and
    judged by every rule against what is stored by then, in whatever order chapters arrive. Contradictions are recorded
    once each, and not where their claim was decided before. A chapter read again adds nothing. Every table is
    checkpointed, so plans do not grow from chapter to chapter.
    """
    names = entities.select(F.col("place").alias("mention_id"), F.array_distinct(F.concat(F.array(F.trim("name")), F.coalesce("aliases", F.array().cast("array<string>")))).alias("names"), F.lower("type").alias("entity_type"))
    names = names.where("names[0] <> ''")
    found = settled(resolve.resolve(names, state.entities, state.aliases, evidence).join(names, "mention_id"))
    fresh = found.where("entity_id IS NULL").withColumn("entity_id", ident(F.lit(world), S.fold_spaces(F.col("names")[0])))
    now = found.where("entity_id IS NOT NULL").select("mention_id", F.col("entity_id").cast("string").alias("entity_id"), "names", "entity_type").unionByName(fresh.select("mention_id", "entity_id", "names", "entity_type"))
    made = fresh.groupBy("entity_id").agg(F.min_by("names", "mention_id").alias("n"), F.min_by("entity_type", "mention_id").alias("entity_type")).select(F.col("entity_id").alias("id"), F.col("n")[0].alias("canonical_name"), "entity_type")
    renamed = resolve.renames(now.select("mention_id", "entity_id"), names, state.entities)
    new_name = renamed.select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("_new"))
    all_entities = state.entities.join(new_name, "id", "left").select("id", F.coalesce("_new", "canonical_name").alias("canonical_name"), "entity_type").unionByName(made)
    all_entities = settled(all_entities)
    more = now.select("entity_id", F.explode("names").alias("alias")).unionByName(renamed.select("entity_id", "alias")).unionByName(state.aliases)
    canon = all_entities.select(F.col("id").alias("entity_id"), F.lower(F.trim("canonical_name")).alias("_f"))
    all_aliases = more.withColumn("_f", F.lower(F.trim("alias"))).join(canon, ["entity_id", "_f"], "left_anti").groupBy("entity_id", "_f").agg(F.min("alias").alias("alias")).drop("_f")
    all_aliases = settled(all_aliases)

    write = (state.facts.agg(F.max("created_at")).first()[0] or 0.0, state.relations.agg(F.max("created_at")).first()[0] or 0.0)
    at = lambda place: F.lit(float(int(max(write)) + 1)) + place / 1e6
    facts = now.join(entities.select(F.col("place").alias("mention_id"), F.explode("attributes").alias("property_name", "value")), "mention_id").where(~S.is_blank(F.col("value")))
    facts = facts.select(ident(F.lit(world), F.lit(chapter), F.col("mention_id"), F.col("property_name")).alias("version_id"), "entity_id", "property_name", "value", F.lit(chapter).alias("chapter_number"), at(F.col("mention_id")).alias("created_at"))
    all_facts, on_facts = append(state.facts, facts, ["entity_id", "property_name"], F.concat_ws("\u0001", "entity_id", "property_name"), lambda a, b: S.values_equal(F.col(a), F.col(b)), fact_findings, ["entity_id", "property_name"])

    by_name = now.select(F.explode("names").alias("n"), "entity_id", "mention_id").unionByName(all_entities.select(F.col("canonical_name").alias("n"), F.col("id").alias("entity_id"), F.lit(1 << 30).alias("mention_id")))
    by_name = by_name.unionByName(all_aliases.select(F.col("alias").alias("n"), "entity_id", F.lit((1 << 30) + 1).alias("mention_id")))
    by_name = settled(by_name.groupBy(F.lower(F.trim("n")).alias("f")).agg(F.min_by("entity_id", F.struct("mention_id", "entity_id")).alias("entity_id")))
    end = lambda name, side: (by_name.select(F.col("f").alias(f"f_{side}"), F.col("entity_id").alias(f"{side}_id")), F.lower(F.trim(name)) == F.col(f"f_{side}"))
    ends = relations.join(*end("subject", "source")).join(*end("object", "target")).where("source_id <> target_id")
    kind = S.normalize_predicate(F.coalesce("predicate", F.lit("RELATED_TO")))
    rels = ends.select(ident(F.lit(world), F.lit(chapter), F.col("source_id"), F.col("target_id"), kind).alias("version_id"), "source_id", "target_id", kind.alias("relationship_type"), F.lit(chapter).alias("chapter_number"), at(F.col("place")).alias("created_at"))
    rels = rels.groupBy("version_id", "source_id", "target_id", "relationship_type", "chapter_number").agg(F.min("created_at").alias("created_at"))
    hubs = rels.where(F.col("relationship_type").isin(*V.SINGLE_SOURCE_PREDICATES)).select("target_id").distinct().withColumn("hub", F.lit(True))
    rels = rels.join(hubs, "target_id", "left")
    group = F.when(F.col("hub"), F.col("target_id")).otherwise(F.concat_ws("\u0001", "source_id", "target_id"))
    all_relations, on_relations = append(state.relations, rels, ["source_id", "target_id"], group, lambda a, b: F.upper(F.trim(a)) == F.upper(F.trim(b)), relation_findings, ["target_id"])

    event_of = ident(F.lit(world), F.lit(chapter), S.fold_spaces(F.col("description")))
    told = settled(events.where(~S.is_blank(F.col("description"))).withColumn("event_id", event_of))
    new_events = told.select("event_id", F.lit(chapter).alias("chapter_number"), F.coalesce(F.col("type"), F.lit("EVENT")).alias("event_type"), "description").dropDuplicates(["event_id"])
    all_events = state.events.unionByName(new_events.join(state.events.select("event_id"), "event_id", "left_anti"))
    all_participants = state.participants
    if "participants" in events.columns:
        took = told.select("event_id", F.explode("participants").alias("p")).select("event_id", F.col("p.name").alias("name"), F.upper(F.coalesce("p.role", F.lit("PARTICIPANT"))).alias("role"))
        took = took.join(by_name, F.lower(F.trim("name")) == F.col("f")).select("event_id", "entity_id", "role")
        all_participants = all_participants.unionByName(took).distinct()
    surface = F.coalesce("mention", F.trim("name")) if "mention" in entities.columns else F.trim("name")
    said = entities.select(F.col("place").alias("mention_id"), surface.alias("surface_text")).join(now.select("mention_id", "entity_id"), "mention_id")
    said = said.select(ident(F.lit(world), F.lit(chapter), F.col("mention_id")).alias("mention_id"), "entity_id", "surface_text", F.lit(chapter).alias("chapter_number"))
    all_mentions = state.mentions.unionByName(said.join(state.mentions.select("mention_id"), "mention_id", "left_anti"))

    of_facts = on_facts.join(facts.select("version_id", "entity_id", "property_name", "value"), "version_id").withColumn("signature", rules.claim_signature(F.concat_ws("\u0001", "entity_id", "property_name"), F.col("old_value"), F.col("value")))
    pairs = all_relations.select("version_id", ledger.relation_claim(F.col("source_id"), F.col("target_id"), F.col("relationship_type")).alias("claim"))
    of_relations = on_relations.join(pairs, "version_id").join(pairs.select(F.col("version_id").alias("old_version_id"), F.col("claim").alias("old_claim")), "old_version_id").withColumn("signature", ledger.claims_signature(F.array("claim", "old_claim")))
    cols = ["rule_id", "old_version_id", F.col("version_id").alias("new_version_id"), F.array().cast("array<string>").alias("event_refs"), "signature", "confidence"]
    findings = of_facts.select(*cols).unionByName(of_relations.select(*cols))
    if temporal is not None and "id" in events.columns:
        ids = told.select(F.lit(chapter).alias("chapter_number"), F.col("id").alias("event_id")).where("event_id IS NOT NULL")
        rings = rules.temporal_cycles(temporal.withColumn("chapter_number", F.lit(chapter)), ids)
        ring = F.sha2(F.concat_ws("\u0001", F.lit(world), "chapter_number", "cycle"), 256)
        nothing = F.lit(None).cast("string")
        findings = findings.unionByName(rings.select("rule_id", nothing.alias("old_version_id"), nothing.alias("new_version_id"), F.col("cycle").cast("array<string>").alias("event_refs"), ring.alias("signature"), "confidence"))
    findings = findings.withColumns({"contradiction_id": ident(F.lit(world), F.col("rule_id"), F.coalesce("old_version_id", F.lit("")), F.coalesce("new_version_id", F.lit("")), F.concat_ws(",", "event_refs")), "status": F.lit("DETECTED"), "chapter_number": F.lit(chapter)})
    decided = state.contradictions.where("status IN ('RESOLVED', 'DISMISSED')").select("signature")
    fresh_ones = findings.dropDuplicates(["contradiction_id"]).join(state.contradictions.select("contradiction_id"), "contradiction_id", "left_anti").join(decided, "signature", "left_anti")
    return State(
        all_entities, all_aliases, settled(all_facts), settled(all_relations), settled(all_events), settled(all_participants), settled(all_mentions),
        settled(state.contradictions.unionByName(fresh_ones.select(state.contradictions.columns))),
    )


def counters(before: State, after: State, chapter: int) -> dict[str, int]:
    """What a chapter added; one row of counts a table comes to the driver. An entity is updated once for each time the
    chapter lists it."""
    added = lambda a, b, key: a.join(b.select(key), key, "left_anti").count()
    mentions = after.mentions.join(before.mentions.select("mention_id"), "mention_id", "left_anti")
    return {
        "entities_created": added(after.entities, before.entities, "id"), "entities_updated": mentions.join(before.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").count(),
        "facts_added": added(after.facts, before.facts, "version_id"), "relationships_added": added(after.relations, before.relations, "version_id"),
        "events_added": added(after.events, before.events, "event_id"), "contradictions_found": added(after.contradictions, before.contradictions, "contradiction_id"),
    }


def empty_state(spark) -> State:
    make = lambda schema: spark.createDataFrame([], schema)
    return State(
        make("id string, canonical_name string, entity_type string"), make("entity_id string, alias string"),
        make("version_id string, entity_id string, property_name string, value string, chapter_number int, created_at double, status string"),
        make("version_id string, source_id string, target_id string, relationship_type string, chapter_number int, created_at double, status string"),
        make("event_id string, chapter_number int, event_type string, description string"), make("event_id string, entity_id string, role string"),
        make("mention_id string, entity_id string, surface_text string, chapter_number int"),
        make("contradiction_id string, rule_id string, old_version_id string, new_version_id string, event_refs array<string>, signature string, confidence double, status string, chapter_number int"),
    )
