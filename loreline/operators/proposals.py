"""What a re-read chapter would change: new, changed or known, for entities, facts, relationships and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S


def facts(incoming: DataFrame, current: DataFrame, decided: DataFrame) -> DataFrame:
    """incoming (entity_id, property_name, value) against the current ACTIVE values, with change and current_value; claims that
    were decided (entity_id, property_name, a, b: folded values in order) are not raised again. Blank values propose nothing."""
    now = current.select("entity_id", "property_name", F.col("value").alias("current_value"))
    rows = incoming.where(~S.is_blank(F.col("value"))).join(now, ["entity_id", "property_name"], "left")
    change = F.when(F.col("current_value").isNull(), "new").when(S.values_equal(F.col("current_value"), F.col("value")), "known").otherwise("changed")
    x, y = S.fold_spaces(F.col("current_value")), S.fold_spaces(F.col("value"))
    rows = rows.withColumn("change", change).withColumns({"a": F.when(F.col("change") == "changed", F.least(x, y)), "b": F.when(F.col("change") == "changed", F.greatest(x, y))})
    return rows.join(decided, ["entity_id", "property_name", "a", "b"], "left_anti").drop("a", "b")


def relationships(incoming: DataFrame, current: DataFrame, rejected: DataFrame) -> DataFrame:
    """incoming (source_id, target_id, predicate) against the current ACTIVE types; symmetric predicates are also sought the
    other way round, the given direction first. rejected: source_id, target_id, predicate. A loop proposes nothing."""
    rows = incoming.where("source_id <> target_id").withColumn("predicate", F.upper(F.coalesce("predicate", F.lit("RELATED_TO")))).dropDuplicates(["source_id", "target_id", "predicate"])
    rows = rows.join(rejected.select("source_id", "target_id", "predicate").distinct(), ["source_id", "target_id", "predicate"], "left_anti")
    now = current.select("source_id", "target_id", F.col("relationship_type").alias("_same"))
    back = current.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.col("relationship_type").alias("_back"))
    rows = rows.join(now, ["source_id", "target_id"], "left").join(back, ["source_id", "target_id"], "left")
    found = F.coalesce("_same", F.when(S.is_symmetric(F.col("predicate")), F.col("_back")))
    change = F.when(found.isNull(), "new").when(F.upper(found) == F.col("predicate"), "known").otherwise("changed")
    return rows.withColumns({"current_type": found, "change": change}).drop("_same", "_back")


def events(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (chapter_id, description) known by a stored event of the chapter whose description differs by white space at
    most; blank descriptions propose nothing."""
    flat = F.trim(F.regexp_replace("description", r"(?U)\s+", " "))
    have = stored.select("chapter_id", flat.alias("_flat")).distinct().withColumn("_known", F.lit(True))
    rows = incoming.where(~S.is_blank(F.col("description"))).withColumn("_flat", flat).join(have, ["chapter_id", "_flat"], "left")
    return rows.withColumn("change", F.when(F.col("_known"), "known").otherwise("new")).drop("_flat", "_known")


def open_only(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Proposals (id, change, refs array of proposal ids) that are not known and whose every reference is accepted (id)."""
    rows = proposals.where("change <> 'known'")
    missing = rows.select("id", F.explode("refs").alias("ref")).join(accepted.select(F.col("id").alias("ref")), "ref", "left_anti").select("id").distinct()
    return rows.join(missing, "id", "left_anti")


def matches(entities: DataFrame, stored: DataFrame, aliases: DataFrame) -> DataFrame:
    """job, place and entity_id of entities of a reading (job, world_id, place, name, aliases) that a world has: by canonical name in any
    case, else by the first of their names that is a canonical name or alias there; of equals the least id.

    stored: world_id, entity_id, canonical_name. aliases: entity_id, alias.
    """
    known = stored.select("world_id", "entity_id", F.lower("canonical_name").alias("n"), F.lit(0).alias("side"))
    known = known.unionByName(stored.select("world_id", "entity_id").join(aliases, "entity_id").select("world_id", "entity_id", F.lower("alias").alias("n"), F.lit(1).alias("side")))
    names = entities.select("job", "world_id", "place", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k", "n")).withColumn("n", F.lower(F.trim("n"))).where("n <> ''")
    found = names.join(known, ["world_id", "n"]).withColumn("rank", F.when((F.col("k") == 0) & (F.col("side") == 0), -1).otherwise(F.col("k")))
    return found.groupBy("job", "place").agg(F.min_by("entity_id", F.struct("rank", "entity_id")).alias("entity_id"))


def build(entities: DataFrame, relations: DataFrame, happened: DataFrame, found: DataFrame, stored: DataFrame, aliases: DataFrame, values: DataFrame, types: DataFrame, told: DataFrame, decided: DataFrame, rejected: DataFrame) -> DataFrame:
    """All proposals of readings in one table: entities, aliases, facts, relationships and events, with ids p-001, p-002, ... a job.

    entities: job, world_id, place, name, type, aliases, attributes (map). relations: job, world_id, place, subject, predicate, object.
    happened: job, place, chapter_id, description. found: job, place, entity_id (see matches; another resolver may give it). stored, aliases: see
    matches. values: entity_id, property_name, value (ACTIVE). types: source_id, target_id, relationship_type (ACTIVE). told: chapter_id,
    description. decided, rejected: see facts and relationships.

    Returns job, id, kind, change, entity_id (of a stored entity), ref (id of the proposal of a new one), name (canonical name, alias, property,
    predicate or description), value, current, target_id and target_ref. Entities come in order, each with its aliases (of a known
    one under a name that it lacks) and its facts, then relationships, then events. A name stands for the entity of the same reading that was last given it, else for
    a stored one; a relation whose ends are not both known, or are one, proposes nothing.
    """
    flat = lambda c: F.lower(F.trim(c))
    mine = entities.where(~S.is_blank(F.col("name"))).withColumns({"name": F.trim("name"), "type": F.lower(F.coalesce("type", F.lit("unknown")))})
    mine = mine.withColumn("aliases", F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: flat(a) != F.lower("name"))).join(found, ["job", "place"], "left")
    none = F.lit(None)
    text = lambda v=none: v.cast("string")
    key = lambda part, *rest: F.array(F.lit(part).cast("long"), *[c.cast("long") for c in rest])
    rows = [mine.select("job", key(0, F.col("place"), F.lit(0), F.lit(0)).alias("at"), F.lit("entity").alias("kind"), F.when(F.col("entity_id").isNull(), "new").otherwise("known").alias("change"), "entity_id", F.when(F.col("entity_id").isNull(), F.col("place")).alias("own"), "name", F.col("type").alias("value"), text().alias("current"))]

    have = stored.select("entity_id", F.lower("canonical_name").alias("n")).unionByName(aliases.select("entity_id", F.lower("alias").alias("n"))).distinct()
    called = mine.where("entity_id IS NOT NULL").select("job", "place", "entity_id", F.posexplode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("k", "name")).withColumn("n", F.lower("name")).join(have, ["entity_id", "n"], "left_anti")
    rows.append(called.select("job", key(0, F.col("place"), F.lit(1), F.col("k")).alias("at"), F.lit("alias").alias("kind"), F.lit("new").alias("change"), "entity_id", F.lit(None).cast("long").alias("own"), "name", text().alias("value"), text().alias("current")))

    said = mine.select("job", "place", "entity_id", F.explode(F.map_entries("attributes")).alias("a")).select("job", "place", "entity_id", F.col("a.key").alias("property_name"), F.col("a.value").alias("value"))
    judged = facts(said, values, decided)
    nth = F.row_number().over(W.partitionBy("job", "place").orderBy("property_name"))
    rows.append(judged.select("job", key(0, F.col("place"), F.lit(2), nth).alias("at"), F.lit("fact").alias("kind"), "change", "entity_id", F.when(F.col("entity_id").isNull(), F.col("place")).alias("own"), F.col("property_name").alias("name"), "value", F.col("current_value").alias("current")))

    names = mine.select("job", "world_id", "place", "entity_id", F.explode(F.concat(F.array("name"), "aliases")).alias("n")).withColumn("n", F.lower("n"))
    here = names.groupBy("job", "n").agg(F.max_by(F.struct("entity_id", F.when(F.col("entity_id").isNull(), F.col("place")).alias("own")), "place").alias("here"))
    every = stored.select("world_id", "entity_id", F.lower("canonical_name").alias("n"), F.lit(0).alias("side")).unionByName(stored.select("world_id", "entity_id").join(aliases, "entity_id").select("world_id", "entity_id", F.lower("alias").alias("n"), F.lit(1).alias("side")))
    there = every.groupBy("world_id", "n").agg(F.min_by("entity_id", F.struct("side", "entity_id")).alias("there"))
    ends = relations.withColumn("predicate", F.upper(F.coalesce("predicate", F.lit("RELATED_TO"))))
    for side in ("subject", "object"):
        ends = ends.withColumn("n", F.lower(S.without_titles(F.trim(F.coalesce(side, F.lit("")))))).join(here, ["job", "n"], "left").join(there, ["world_id", "n"], "left")
        ends = ends.withColumns({f"{side}_id": F.coalesce("here.entity_id", F.when(F.col("here").isNull(), F.col("there"))), f"{side}_own": F.col("here.own")}).drop("n", "here", "there")
    whom = lambda s: F.struct(f"{s}_id", f"{s}_own")
    ends = ends.where((F.col("subject_id").isNotNull() | F.col("subject_own").isNotNull()) & (F.col("object_id").isNotNull() | F.col("object_own").isNotNull()) & ~(F.col("subject_id").eqNullSafe(F.col("object_id")) & F.col("subject_own").eqNullSafe(F.col("object_own"))))
    first = ends.groupBy("job", whom("subject").alias("s"), "predicate", whom("object").alias("o")).agg(F.min("place").alias("place"))
    first = first.select("job", "place", "predicate", F.col("s.subject_id").alias("source_id"), F.col("o.object_id").alias("target_id"), F.col("s.subject_own").alias("own"), F.col("o.object_own").alias("target_own"))
    first = first.join(rejected.select("source_id", "target_id", "predicate").distinct(), ["source_id", "target_id", "predicate"], "left_anti")
    now = types.select("source_id", "target_id", F.col("relationship_type").alias("_same"))
    back = types.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), F.col("relationship_type").alias("_back"))
    first = first.join(now, ["source_id", "target_id"], "left").join(back, ["source_id", "target_id"], "left").withColumn("current", F.coalesce("_same", F.when(S.is_symmetric(F.col("predicate")), F.col("_back"))))
    change = F.when(F.col("current").isNull(), "new").when(F.upper("current") == F.col("predicate"), "known").otherwise("changed")
    rows.append(first.select("job", key(1, F.col("place"), F.lit(0), F.lit(0)).alias("at"), F.lit("relationship").alias("kind"), change.alias("change"), F.col("source_id").alias("entity_id"), "own", F.col("predicate").alias("name"), text().alias("value"), "current", "target_id", "target_own"))

    rows.append(events(happened, told).select("job", key(2, F.col("place"), F.lit(0), F.lit(0)).alias("at"), F.lit("event").alias("kind"), "change", F.regexp_replace("description", r"(?U)^\s+|\s+$", "").alias("name")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out = out.withColumn("id", F.concat(F.lit("p-"), F.format_string("%03d", F.row_number().over(W.partitionBy("job").orderBy("at")))))
    made = out.where("kind = 'entity' AND change = 'new'").select("job", "own", F.col("id").alias("ref"))
    out = out.join(made, ["job", "own"], "left").join(made.select("job", F.col("own").alias("target_own"), F.col("ref").alias("target_ref")), ["job", "target_own"], "left")
    return out.select("job", "id", "kind", "change", "entity_id", F.when(F.col("kind") != "entity", F.col("ref")).alias("ref"), "name", "value", "current", "target_id", "target_ref")
