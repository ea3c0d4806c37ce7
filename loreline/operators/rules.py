"""Contradiction rules: each takes versions and returns findings with one schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.functions import vocabulary as V
from loreline.operators import versions as ver

#: rule name to function; more can be registered. Facts first, then relationships, then time, in the order of the checks.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def rule(name: str):
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = fn
        return fn

    return add


def _finding(rows: DataFrame, name: str, confidence: float, old: str, key: list[str]) -> DataFrame:
    return rows.select(F.lit(name).alias("rule_id"), *key, F.col(old).alias("old_version_id"), F.col("version_id").alias("new_version_id"), F.lit(confidence).alias("confidence"))


@rule("IMMUTABLE_FACT")
def immutable_fact(facts: DataFrame, key: list[str], value: str = "value", immutable: Column | None = None) -> DataFrame:
    """A value other than the last ACTIVE one of a property that cannot change; blank values neither find nor count."""
    fixed = S.property_kind(F.col("property_name")) == "immutable" if immutable is None else immutable
    usable = ~S.is_blank(F.col(value).cast("string"))
    judged = ver.last_active_before(facts.where(fixed), key, F.col(value).cast("string"), usable)
    differs = F.col("reference_id").isNotNull() & usable & ~S.values_equal(F.col("reference_value"), F.col(value).cast("string"))
    return _finding(judged.where(differs), "IMMUTABLE_FACT", 0.9, "reference_id", key)


@rule("AGE_MONOTONIC")
def age_monotonic(facts: DataFrame, key: list[str], age: Column) -> DataFrame:
    """An age under that of the nearest earlier chapter, or over that of the nearest later one: up to two findings."""
    near = ver.nearest_chapters(facts.withColumn("_age", age), key, F.col("_age"), F.col("_age").isNotNull()).where("_age IS NOT NULL AND chapter_number IS NOT NULL")
    fell = _finding(near.where("_age < before_value"), "AGE_MONOTONIC", 0.7, "before_id", key)
    return fell.unionByName(_finding(near.where("_age > after_value"), "AGE_MONOTONIC", 0.7, "after_id", key))


@rule("DEAD_THEN_ALIVE")
def dead_then_alive(facts: DataFrame, key: list[str], state: Column) -> DataFrame:
    """ALIVE after a chapter that says DEAD (the latest such), or DEAD before one that says ALIVE (the earliest)."""
    rows = facts.withColumn("_state", state)
    dead = ver.nearest_chapters(rows, key, F.col("_state"), F.col("_state") == "DEAD").where("_state = 'ALIVE' AND before_id IS NOT NULL")
    alive = ver.nearest_chapters(rows, key, F.col("_state"), F.col("_state") == "ALIVE").where("_state = 'DEAD' AND after_id IS NOT NULL")
    return _finding(dead, "DEAD_THEN_ALIVE", 0.7, "before_id", key).unionByName(_finding(alive, "DEAD_THEN_ALIVE", 0.7, "after_id", key))


@rule("RELATIONSHIP_INCOMPATIBLE")
def incompatible(relations: DataFrame, key: list[str]) -> DataFrame:
    """A type that is listed as incompatible with the pair's last ACTIVE one, of the same direction."""
    judged = ver.last_active_before(relations, key, F.col("relationship_type"), F.coalesce("relationship_type", F.lit("")) != "")
    low, high = F.least("reference_value", "relationship_type"), F.greatest("reference_value", "relationship_type")
    clash = F.lit(False)
    for a, b in V.INCOMPATIBLE_PREDICATES:
        clash = clash | ((low == min(a, b)) & (high == max(a, b)))
    return _finding(judged.where(F.col("reference_id").isNotNull() & clash), "RELATIONSHIP_INCOMPATIBLE", 0.85, "reference_id", key)


@rule("RELATIONSHIP_SINGLE_SOURCE")
def single_source(relations: DataFrame, key: list[str]) -> DataFrame:
    """A second source of a single-source type for a target; the last earlier ACTIVE one of another source is the reference.

    For each new version only two earlier ones can matter: the target's last, and the last of another source than that
    one. Both follow from runs of one source, so no version meets all others.
    """
    from pyspark.sql import Window as W

    rows = relations.where(F.col("relationship_type").isin(*V.SINGLE_SOURCE_PREDICATES))
    w = W.partitionBy("target_id", "relationship_type").orderBy("created_at", "version_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    active = F.when(F.col("status") == "ACTIVE", F.struct("source_id", "version_id"))
    rows = rows.withColumn("_last", F.last(active, ignorenulls=True).over(before))
    turn = F.when((F.col("status") == "ACTIVE") & F.col("_last").isNotNull() & (F.col("_last.source_id") != F.col("source_id")), F.col("_last"))
    rows = rows.withColumn("_other", F.last(turn, ignorenulls=True).over(before))
    found = F.when(F.col("_last.source_id") != F.col("source_id"), F.col("_last.version_id")).when(F.col("_other.source_id") != F.col("source_id"), F.col("_other.version_id"))
    return _finding(rows.withColumn("_ref", found).where("_ref IS NOT NULL"), "RELATIONSHIP_SINGLE_SOURCE", 0.6, "_ref", key)


def _cycles(edges: list[tuple[str, str]], nodes: list[str]) -> list[list[str]]:
    """Cycles closed by the back edges of a depth-first walk in sorted order, each once, from its least node."""
    after: dict[str, list[str]] = {n: [] for n in sorted(set(nodes))}
    for a, b in sorted(set(edges)):
        if a in after and b in after:
            after[a].append(b)
    place: dict[str, int] = {}
    done: set[str] = set()
    found: dict[tuple[str, ...], None] = {}
    for root in after:
        if root in done:
            continue
        path, todo = [root], [iter(after[root])]
        place[root] = 0
        while path:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                last = path.pop()
                del place[last]
                done.add(last)
            elif step in place:
                ring = path[place[step] :]
                low = ring.index(min(ring))
                found.setdefault(tuple(ring[low:] + ring[:low]))
            elif step not in done:
                place[step] = len(path)
                path.append(step)
                todo.append(iter(after[step]))
    return [list(c) for c in found]


@rule("TEMPORAL_CYCLE")
def temporal_cycles(relations: DataFrame, events: DataFrame, scope: str | list[str] = "chapter_number") -> DataFrame:
    """Cycles among BEFORE and AFTER relations (scope, event_1, relation, event_2) of the events (scope, event_id) of one
    scope, which is a chapter, or world and chapter where there are several worlds: scope, cycle (event ids from the
    least), rule_id, confidence. Unknown events and other relations do not count."""
    scope = [scope] if isinstance(scope, str) else scope
    kind = F.upper("relation")
    edges = relations.where(kind.isin("BEFORE", "AFTER")).select(
        *scope, F.when(kind == "BEFORE", F.col("event_1")).otherwise(F.col("event_2")).alias("a"), F.when(kind == "BEFORE", F.col("event_2")).otherwise(F.col("event_1")).alias("b")
    )
    grouped = edges.groupBy(*scope).agg(F.collect_set(F.struct("a", "b")).alias("edges")).join(events.groupBy(*scope).agg(F.collect_set("event_id").alias("nodes")), scope)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*s, c) for *s, e, n in frame.itertuples(index=False) for c in _cycles([(x["a"], x["b"]) for x in e], list(n))]
            yield pd.DataFrame(rows, columns=[*scope, "cycle"])

    kind_of = dict(edges.dtypes)
    found = grouped.mapInPandas(run, ", ".join([*[f"{c} {kind_of[c]}" for c in scope], f"cycle array<{kind_of['a']}>"]))
    return found.withColumns({"rule_id": F.lit("TEMPORAL_CYCLE"), "confidence": F.lit(1.0)})


def claim_signature(fact: Column, a: Column, b: Column) -> Column:
    """The same for a claim however often it is found: the fact and its two folded values, in order."""
    x, y = S.fold_spaces(a), S.fold_spaces(b)
    return F.sha2(F.concat_ws("\u0001", fact.cast("string"), F.least(x, y), F.greatest(x, y)), 256)


def record(findings: DataFrame, recorded: DataFrame, refs: list[str]) -> DataFrame:
    """Findings not yet recorded: none with the same rule and the same references, nulls equal."""
    both = [findings[c].eqNullSafe(recorded[c]) for c in ["rule_id", *refs]]
    cond = both[0]
    for c in both[1:]:
        cond = cond & c
    return findings.join(recorded, cond, "left_anti").dropDuplicates(["rule_id", *refs])


def resolve(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """versions after decisions (chosen_id, other_id): the chosen one ACTIVE, the other SUPERSEDED."""
    marks = decisions.select(F.col("chosen_id").alias("version_id"), F.lit("ACTIVE").alias("_to")).unionByName(decisions.select(F.col("other_id").alias("version_id"), F.lit("SUPERSEDED").alias("_to")))
    return versions.join(marks.groupBy("version_id").agg(F.min("_to").alias("_to")), "version_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")
