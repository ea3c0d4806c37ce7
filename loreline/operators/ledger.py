"""The ledger of contradictions: what a contradiction is about, what the author decided, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import rules, texts


def relation_claim(source: Column, target: Column, kind: Column) -> Column:
    """A relationship as a claim; direction counts, case and white space of the type do not."""
    return F.concat_ws("\u0001", source.cast("string"), target.cast("string"), S.fold_spaces(kind))


def event_claim(chapter: Column, kind: Column, description: Column) -> Column:
    return F.concat_ws("\u0001", chapter.cast("string"), kind, S.fold_spaces(description))


def claims_signature(claims: Column) -> Column:
    """The same for a set of claims whatever their order and however often each is given."""
    return F.sha2(F.concat_ws("\u0002", F.array_sort(F.array_distinct(claims))), 256)


def signatures(contradictions: DataFrame, facts: DataFrame, relations: DataFrame, events: DataFrame) -> DataFrame:
    """id, family, claims (of relationships) and signature of each contradiction (id, old and new fact and relationship
    version, event_id_a, event_id_b). Facts: the fact and its two folded values, where both versions are of one fact;
    relationships: their two claims; events: the one or two events. What names no known rows of one kind has no signature."""
    c = contradictions.select("id", "old_fact_version_id", "new_fact_version_id", "old_relationship_version_id", "new_relationship_version_id", "event_id_a", "event_id_b")
    side = lambda df, name, **cols: df.select(F.col(next(iter(df.columns))).alias(name), *[v.alias(k) for k, v in cols.items()])
    fact = F.concat_ws("\u0001", "entity_id", "property_name")
    a, b = (side(facts.select("version_id", "entity_id", "property_name", "value"), f"{n}_fact_version_id", **{f"{n}_fact": fact, f"{n}_value": F.col("value").cast("string")}) for n in ("old", "new"))
    of_facts = c.join(a, "old_fact_version_id").join(b, "new_fact_version_id").where("old_fact = new_fact")
    of_facts = of_facts.select("id", F.lit("fact").alias("family"), F.array().cast("array<string>").alias("claims"), rules.claim_signature(F.col("old_fact"), F.col("old_value"), F.col("new_value")).alias("signature"))
    claim = relation_claim(F.col("source_id"), F.col("target_id"), F.col("relationship_type"))
    a, b = (side(relations.select("version_id", "source_id", "target_id", "relationship_type"), f"{n}_relationship_version_id", **{f"{n}_claim": claim}) for n in ("old", "new"))
    both = F.array("old_claim", "new_claim")
    of_relations = c.join(a, "old_relationship_version_id").join(b, "new_relationship_version_id").select("id", F.lit("relationship").alias("family"), F.array_sort(F.array_distinct(both)).alias("claims"), claims_signature(both).alias("signature"))
    told = event_claim(F.col("chapter_number"), F.col("event_type"), F.col("description"))
    a, b = (side(events.select("event_id", "chapter_number", "event_type", "description"), f"event_id_{n}", **{f"claim_{n}": told}) for n in "ab")
    linked = c.where("event_id_a IS NOT NULL OR event_id_b IS NOT NULL").join(a, "event_id_a", "left").join(b, "event_id_b", "left")
    linked = linked.where("(event_id_a IS NULL) = (claim_a IS NULL) AND (event_id_b IS NULL) = (claim_b IS NULL)")
    of_events = linked.select("id", F.lit("event").alias("family"), F.array().cast("array<string>").alias("claims"), claims_signature(F.array_compact(F.array("claim_a", "claim_b"))).alias("signature"))
    every = of_facts.withColumn("rank", F.lit(0)).unionByName(of_relations.withColumn("rank", F.lit(1))).unionByName(of_events.withColumn("rank", F.lit(2)))
    best = every.groupBy("id").agg(F.min_by(F.struct("family", "claims", "signature"), "rank").alias("s")).select("id", "s.*")
    return contradictions.select("id").join(best, "id", "left")


def rejected_relations(decided: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims (claim) that stay rejected: those of a decided contradiction (claims array) of which another claim is ACTIVE
    among relations, be it of another pair."""
    active = relations.where("status = 'ACTIVE'").select(relation_claim(F.col("source_id"), F.col("target_id"), F.col("relationship_type")).alias("claim")).distinct()
    each = decided.where(F.size("claims") > 1).select("claims", F.explode("claims").alias("claim"))
    holding = each.join(active, "claim", "left_semi").groupBy("claims").agg(F.collect_set("claim").alias("held"))
    return holding.select("held", F.explode("claims").alias("claim")).where(F.size(F.array_except("held", F.array("claim"))) > 0).select("claim").distinct()


def recorded_once(findings: DataFrame, recorded: DataFrame, refs: list[str]) -> DataFrame:
    """Findings not yet recorded in any status: none with the same rule and the same references (nulls equal), and where all
    references are null also the same explanation. Repeats among findings count once."""
    unnamed = lambda df: F.when(F.coalesce(*[F.col(c).cast("string") for c in refs]).isNull(), F.col("explanation"))
    told = recorded.select("rule_id", *refs, unnamed(recorded).alias("said"))
    mine = findings.withColumn("said", unnamed(findings))
    same = [mine[c].eqNullSafe(told[c]) for c in ["rule_id", *refs, "said"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return mine.join(told, cond, "left_anti").dropDuplicates(["rule_id", *refs, "said"]).drop("said")


def resolution_errors(contradictions: DataFrame, choices: DataFrame) -> DataFrame:
    """id and reason of choices (id, preferred_id) that cannot be carried out: of an unknown contradiction (id,
    old_version_id, new_version_id), or for a version that is neither of its two."""
    rows = choices.join(contradictions.select("id", "old_version_id", "new_version_id", F.lit(True).alias("known")), "id", "left")
    reason = F.when(F.col("known").isNull(), "unknown contradiction").when(
        F.col("preferred_id").isNotNull() & F.col("old_version_id").isNotNull() & F.col("new_version_id").isNotNull() & ~F.col("preferred_id").isin(F.col("old_version_id"), F.col("new_version_id")), "not one of the two"
    )
    return rows.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def resolved(contradictions: DataFrame, versions: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """contradictions and versions after choices (id, preferred_id, status): the preferred version becomes ACTIVE, the other
    SUPERSEDED, and the contradiction takes the status (RESOLVED where none is given). Choices with an error change nothing."""
    good = choices.join(resolution_errors(contradictions, choices), "id", "left_anti")
    both = good.join(contradictions.select("id", "old_version_id", "new_version_id"), "id").where("preferred_id IS NOT NULL AND old_version_id IS NOT NULL AND new_version_id IS NOT NULL")
    other = F.when(F.col("preferred_id") == F.col("new_version_id"), F.col("old_version_id")).otherwise(F.col("new_version_id"))
    after = rules.resolve(versions, both.select(F.col("preferred_id").alias("chosen_id"), other.alias("other_id")))
    return with_status(contradictions, good.select("id", F.coalesce("status", F.lit("RESOLVED")).alias("status"))), after


def with_status(contradictions: DataFrame, changes: DataFrame) -> DataFrame:
    """contradictions with the status of changes (id, status): dismissed, reopened or whatever is asked for."""
    new = changes.groupBy("id").agg(F.max("status").alias("to"))
    return contradictions.join(new, "id", "left").withColumn("status", F.coalesce("to", "status")).drop("to").select(contradictions.columns)


def fact_conflict(prop: Column, old: Column, new: Column) -> Column:
    """Two values of a fact outside any chapter: only an immutable property can conflict, by another value than a known one."""
    return (S.property_kind(prop) == "immutable") & ~S.is_blank(old) & ~S.is_blank(new) & ~S.values_equal(old, new)


def relation_conflict(old: Column, new: Column) -> Column:
    """Two types of a pair outside any chapter."""
    from loreline.functions import vocabulary as V

    a, b = S.normalize_predicate(old), S.normalize_predicate(new)
    out = F.lit(False)
    for x, y in V.INCOMPATIBLE_PREDICATES:
        out = out | ((F.least(a, b) == min(x, y)) & (F.greatest(a, b) == max(x, y)))
    return out


def _sides(contradictions: DataFrame, old: str, new: str) -> DataFrame:
    sides = F.array(F.struct(F.lit("old").alias("side"), F.col(old).alias("version_id")), F.struct(F.lit("new").alias("side"), F.col(new).alias("version_id")))
    return contradictions.select("id", F.explode(sides).alias("s")).select("id", "s.*").where("version_id IS NOT NULL")


def _located(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """rows (id, side, chapter_id, values, names) with where their chapter tells of them; the key holds world and manuscript apart."""
    told = rows.join(chapters.select("chapter_id", "chapter_number", "text"), "chapter_id", "left").withColumn("_key", F.to_json(F.struct("id", "side")))
    at = texts.locate(told.where("text IS NOT NULL"), "_key", "text", "values", "names").select("_key", "line", "start", "end")
    found = told.join(at, "_key", "left")
    label = F.when(F.col("chapter_id").isNull(), "Added manually").when(F.col("line").isNull(), F.format_string("Chapter %d", "chapter_number")).otherwise(F.format_string("Chapter %d · line %d", "chapter_number", "line"))
    return found.select("id", "side", "chapter_id", "chapter_number", "line", "start", "end", F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("sentence"), label.alias("label"))


def sources(contradictions: DataFrame, versions: DataFrame, chapters: DataFrame, names: DataFrame) -> DataFrame:
    """Where both sides of a contradiction of facts (id, old_version_id, new_version_id) stand: id, side, chapter_id, chapter_number, line, start and end
    (of the sentence), sentence and label. The sentence of the version's chapter is taken that best shows the value near a name of
    the entity (texts.locate); null if none shows it. versions: version_id, entity_id, chapter_id (null: entered by hand), value. chapters: chapter_id,
    chapter_number, text (the current one). names: entity_id, names (array).
    """
    rows = _sides(contradictions, "old_version_id", "new_version_id").join(versions.select("version_id", "entity_id", "chapter_id", F.col("value").cast("string").alias("value")), "version_id")
    return _located(rows.join(names, "entity_id", "left").withColumn("values", F.array(F.coalesce("value", F.lit("")))), chapters)


def relation_sources(contradictions: DataFrame, versions: DataFrame, chapters: DataFrame, names: DataFrame) -> DataFrame:
    """The same for relationships (versions: version_id, source_id, target_id, chapter_id): the sentence that names both ends."""
    rows = _sides(contradictions, "old_version_id", "new_version_id").join(versions.select("version_id", "source_id", "target_id", "chapter_id"), "version_id")
    for end in ("source", "target"):
        rows = rows.join(names.select(F.col("entity_id").alias(f"{end}_id"), F.col("names").alias(f"_{end}")), f"{end}_id", "left")
    return _located(rows.withColumns({"values": F.array_compact(F.array(F.get("_target", F.lit(0)), F.get("_source", F.lit(0)))), "names": F.concat("_source", "_target")}), chapters)
