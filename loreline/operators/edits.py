"""Manual edits of a world: additions that supersede, deletions that cascade, proposals that are applied in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import integrate
from loreline.sources.shared import plain_unions, settled


def add_facts(versions: DataFrame, added: DataFrame) -> DataFrame:
    """versions with added ones as ACTIVE: every ACTIVE version of their keys (entity_id, property_name) is SUPERSEDED, equal or not."""
    keys = added.select("entity_id", "property_name").distinct().withColumn("_new", F.lit(True))
    old = versions.join(keys, ["entity_id", "property_name"], "left")
    old = old.withColumn("status", F.when(F.col("_new") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status"))).drop("_new")
    return old.unionByName(added.withColumn("status", F.lit("ACTIVE")).select(*versions.columns))


def judged_facts(versions: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions after manual additions that the rules judge as they judge a chapter's, and what they found. A clean one is ACTIVE and supersedes the
    newest ACTIVE version of its key, equal or not; one that is found against is CONTRADICTED and the others stay. Additions to one key
    follow each other by created_at and version_id; one whose version_id is stored is not written again."""
    key = ["entity_id", "property_name"]
    return integrate.append(versions, added, key, F.concat_ws("\u0001", *key), lambda a, b: F.lit(False), integrate.fact_findings, key)


def judged_relations(versions: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for relations (source_id, target_id, relationship_type), and the additions refused: those without a type, and those that the pair's
    ACTIVE version says by then. Additions to one target follow each other, for a second source may speak against the first."""
    pair = ["source_id", "target_id"]
    rows = added.withColumn("relationship_type", F.trim("relationship_type"))
    blank, rows = rows.where(S.is_blank(F.col("relationship_type"))), rows.where(~S.is_blank(F.col("relationship_type")))
    rows = settled(rows.join(versions.select("version_id"), "version_id", "left_anti").withColumn("_turn", F.row_number().over(W.partitionBy("target_id").orderBy("created_at", "version_id"))))
    plain_unions(versions.sparkSession)
    near = rows.select("target_id").distinct()
    rest, now = versions.join(near, "target_id", "left_anti").select(versions.columns), versions.join(near, "target_id", "left_semi").select(versions.columns)
    refused, found = [blank.select(added.columns)], []
    for turn in range(1, (rows.agg(F.max("_turn")).first()[0] or 0) + 1):
        new = rows.where(F.col("_turn") == turn).select(added.columns)
        said = settled(rejected_relations(now.where("status = 'ACTIVE'").withColumn("relationship_type", F.trim("relationship_type")), new))
        now, hits = integrate.append(now, new.join(said.select("version_id"), "version_id", "left_anti"), pair, F.col("target_id"), lambda a, b: F.upper(F.trim(a)) == F.upper(F.trim(b)), integrate.relation_findings, ["target_id"])
        refused, found = [*refused, said], [*found, hits]
    hits = reduce(DataFrame.unionByName, found) if found else integrate.relation_findings(rows.limit(0), now)
    return rest.unionByName(now), hits, reduce(DataFrame.unionByName, refused)


def rejected_relations(current: DataFrame, added: DataFrame) -> DataFrame:
    """added relations (source_id, target_id, relationship_type) that the pair's current ACTIVE type already says."""
    now = current.select("source_id", "target_id", F.upper("relationship_type").alias("_t"))
    return added.join(now, (added["source_id"] == now["source_id"]) & (added["target_id"] == now["target_id"]) & (F.upper(added["relationship_type"]) == now["_t"]), "left_semi")


def without(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """rows none of whose columns names an id in gone."""
    ids = gone.select(F.col(gone.columns[0]).alias("_id")).distinct()
    for c in columns:
        rows = rows.join(ids, rows[c] == ids["_id"], "left_anti")
    return rows


def unlink(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """rows with column set to null where it names an id in gone: versions of a deleted chapter stay, without a chapter."""
    ids = gone.select(F.col(gone.columns[0]).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(ids, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def new_aliases(entities: DataFrame, known: DataFrame, added: DataFrame) -> DataFrame:
    """added aliases (entity_id, alias) that are neither known nor the entity's name, whatever their case; each once."""
    f = S.fold_spaces
    have = known.select("entity_id", f(F.col("alias")).alias("_f")).unionByName(entities.select(F.col("id").alias("entity_id"), f(F.col("canonical_name")).alias("_f")))
    rows = added.where(~S.is_blank(F.col("alias"))).withColumn("_f", f(F.col("alias"))).join(have, ["entity_id", "_f"], "left_anti")
    return rows.groupBy("entity_id", "_f").agg(F.min(F.trim("alias")).alias("alias")).drop("_f")


def participant_errors(participants: DataFrame, entities: DataFrame) -> DataFrame:
    """event_id, entity_id and error of participants that are listed twice or are no entity of the event's world."""
    twice = participants.groupBy("event_id", "entity_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id", "entity_id", F.lit("listed twice").alias("error"))
    known = entities.select(F.col("id").alias("entity_id"), "world_id")
    return twice.unionByName(participants.join(known, ["entity_id", "world_id"], "left_anti").select("event_id", "entity_id", F.lit("not in this world").alias("error")))


def move_events(events: DataFrame, moved: DataFrame) -> DataFrame:
    """events with the chapter_number of moved (event_id, chapter_number); one that changes chapter loses its sequence_index."""
    m = moved.select("event_id", F.col("chapter_number").alias("_to"), F.lit(True).alias("_m"))
    rows = events.join(m, "event_id", "left")
    changed = F.col("_m") & ~F.col("_to").eqNullSafe(F.col("chapter_number"))
    rows = rows.withColumn("sequence_index", F.when(F.coalesce(changed, F.lit(False)), F.lit(None)).otherwise(F.col("sequence_index")))
    return rows.withColumn("chapter_number", F.when(F.col("_m"), F.col("_to")).otherwise(F.col("chapter_number"))).drop("_to", "_m")


def applicable(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted proposals (id, kind, refs array<string>) whose references are accepted entities, in the order of their kinds, place from 1.
    An event stays without the participants that are not; other kinds go if a reference does."""
    rows = proposals.join(accepted.select("id"), "id", "left_semi")
    people = rows.where("kind = 'entity'").select(F.col("id").alias("ref"))
    good = rows.select("id", F.explode("refs").alias("ref")).join(people, "ref", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("_kept"))
    rows = rows.join(good, "id", "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))
    order = F.array_position(F.array(*[F.lit(k) for k in ("entity", "alias", "fact", "relationship", "event")]), F.col("kind"))
    return rows.where((F.col("kind") == "event") | (F.size("_kept") == F.size("refs"))).select("id", "kind", F.col("_kept").alias("refs"), order.alias("place"))
