"""Rules, slices, graph and timeline on small worlds with known answers."""

import itertools

from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import graph, rules
from loreline.operators import versions as ver

KEY = ["entity_id", "property_name"]


def facts(spark, rows):
    """(version_id, property, value, chapter, status), written in this order."""
    return spark.createDataFrame([(v, 1, p, x, c, s, i) for i, (v, p, x, c, s) in enumerate(rows)], "version_id int, entity_id int, property_name string, value string, chapter_number int, status string, created_at int")


def found(df):
    return sorted((r.old_version_id, r.new_version_id) for r in df.collect())


def test_immutable(spark):
    f = facts(spark, [(1, "Eye Color", "grey", 1, "ACTIVE"), (2, "Eye Color", "green", 2, "CONTRADICTED"), (3, "Eye Color", " GREY ", 3, "ACTIVE"), (4, "Eye Color", "", 4, "ACTIVE"), (5, "Eye Color", "blue", 5, "ACTIVE"), (6, "hair", "red", 1, "ACTIVE"), (7, "hair", "black", 2, "ACTIVE")])
    assert found(rules.immutable_fact(f, KEY)) == [(1, 2), (3, 5)]


def test_age(spark):
    f = facts(spark, [(1, "age", "30", 1, "ACTIVE"), (2, "age", "25", 2, "ACTIVE"), (3, "age", "20", 2, "SUPERSEDED"), (4, "age", "40", None, "ACTIVE"), (5, "age", "x", 3, "ACTIVE"), (6, "age", "28", 4, "CONTRADICTED")])
    age = S.parse_age(F.col("value"))
    assert found(rules.age_monotonic(f, KEY, age)) == [(1, 2), (1, 3), (2, 1)]


def test_dead_then_alive(spark):
    f = facts(spark, [(1, "status", "dead", 2, "ACTIVE"), (2, "status", "alive", 4, "ACTIVE"), (3, "status", "alive", 1, "ACTIVE"), (4, "status", "missing", 5, "ACTIVE"), (5, "status", "alive", 2, "ACTIVE")])
    assert found(rules.dead_then_alive(f, KEY, S.life_state(F.col("value")))) == [(1, 2), (2, 1)]


def relations(spark, rows):
    return spark.createDataFrame([(i, a, b, k, s, i) for i, (a, b, k, s) in enumerate(rows)], "version_id int, source_id string, target_id string, relationship_type string, status string, created_at int")


def test_relationship_rules(spark):
    r = relations(spark, [("a", "b", "FRIEND_OF", "ACTIVE"), ("a", "b", "ENEMY_OF", "CONTRADICTED"), ("b", "a", "ENEMY_OF", "ACTIVE"), ("c", "d", "KNOWS", "ACTIVE"), ("c", "d", "ENEMY_OF", "ACTIVE")])
    assert found(rules.incompatible(r, ["source_id", "target_id"])) == [(0, 1)]
    r = relations(spark, [("a", "x", "FATHER_OF", "ACTIVE"), ("a", "x", "FATHER_OF", "ACTIVE"), ("b", "x", "FATHER_OF", "CONTRADICTED"), ("a", "x", "FATHER_OF", "ACTIVE"), ("c", "x", "FATHER_OF", "ACTIVE"), ("a", "x", "FATHER_OF", "ACTIVE"), ("d", "y", "FATHER_OF", "ACTIVE")])
    assert found(rules.single_source(r, ["source_id", "target_id"])) == [(1, 2), (3, 4), (4, 5)]


def test_cycles_in_any_order(spark):
    edges = [("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y"), ("Y", "X"), ("A", "Z")]
    for order in list(itertools.permutations(edges))[::120]:
        rel = spark.createDataFrame([(1, a, "before", b) for a, b in order] + [(1, "Q", "BEFORE", "A"), (1, "A", "SIMULTANEOUS", "X")], "chapter_number int, event_1 string, relation string, event_2 string")
        ev = spark.createDataFrame([(1, e) for e in "ABCXYZ"], "chapter_number int, event_id string")
        assert sorted(tuple(r.cycle) for r in rules.temporal_cycles(rel, ev).collect()) == [("A", "B", "C"), ("X", "Y")]


def test_record_and_resolve(spark):
    new = spark.createDataFrame([("R", 1, None), ("R", 2, 3), ("R", 2, 3)], "rule_id string, old_version_id int, new_version_id int")
    old = spark.createDataFrame([("R", 1, None)], "rule_id string, old_version_id int, new_version_id int")
    assert [tuple(r) for r in rules.record(new, old, ["old_version_id", "new_version_id"]).collect()] == [("R", 2, 3)]
    f = facts(spark, [(1, "p", "a", 1, "ACTIVE"), (2, "p", "b", 2, "CONTRADICTED")])
    d = spark.createDataFrame([(2, 1)], "chosen_id int, other_id int")
    assert {r.version_id: r.status for r in rules.resolve(f, d).collect()} == {1: "SUPERSEDED", 2: "ACTIVE"}


def test_slices(spark):
    f = facts(spark, [(1, "s", "alive", 1, "SUPERSEDED"), (2, "s", "missing", 2, "ACTIVE"), (3, "s", "odd", 2, "CONTRADICTED"), (4, "s", "manual", None, "SUPERSEDED")])
    c = spark.createDataFrame([(2, 3, "DETECTED")], "old int, new int, status string")
    at = lambda n: [r.value for r in ver.as_of(f, KEY, n, ver.excluded_versions(c, "old", "new")).collect()]
    assert (at(0), at(1), at(2)) == (["manual"], ["alive"], ["missing"])
    assert [r.value for r in ver.as_of(f, KEY, 2).collect()] == ["odd"]
    assert ver.latest_if_active(f, KEY).count() == 0 and ver.current_or_latest(f, KEY).first().value == "missing"


def test_statuses_after_writes(spark):
    f = facts(spark, [(1, "p", "a", 1, ""), (2, "p", "a", 2, ""), (3, "p", "x", 2, "BAD"), (4, "p", "b", 3, ""), (5, "p", "b", 4, "")])
    got = ver.statuses_after_writes(f, KEY, "value", F.col("status") == "BAD")
    assert {r.version_id: r.stored for r in got.collect()} == {1: "SUPERSEDED", 2: "SUPERSEDED", 3: "CONTRADICTED", 4: "ACTIVE", 5: "ACTIVE"}


def test_timeline_nulls(spark):
    rows = [(1, 2, None, None), (2, 2, 1, None), (3, None, 5, 1), (4, 2, 1, 7), (5, 1, None, 3)]
    e = spark.createDataFrame([(i, c, s, p, 0) for i, c, s, p in rows], "event_id int, chapter_number int, sequence_index int, start_position int, created_at int")
    assert [r.event_id for r in graph.timeline(e, "created_at").orderBy("place").collect()] == [3, 5, 4, 2, 1]


def test_edges_and_degree(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "d")], "source_id string, target_id string")
    r = relations(spark, [("a", "b", "KNOWS", "ACTIVE"), ("a", "b", "OWNS", "SUPERSEDED")]).withColumn("chapter_number", F.lit(1))
    e = graph.edges_latest(pairs, r)
    assert {(x.source_id, x.target_id): x.relationship_type for x in e.collect()} == {("a", "b"): "KNOWS", ("a", "c"): "RELATED_TO", ("d", "d"): "RELATED_TO"}
    assert {x.id: x.degree for x in graph.degrees(e).collect()} == {"a": 2, "b": 1, "c": 1, "d": 2}
