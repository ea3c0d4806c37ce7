"""Schema checks, hybrid documents, pairs asked for, and links that a text names."""

import pytest

from loreline.operators import hybrids, validate

SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["id", "items"],
    "properties": {"id": {"type": "string", "minLength": 1, "pattern": "^[a-z]+$"}, "kind": {"enum": ["a", None]}, "v": {"const": "1.0"}, "items": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/$defs/n"}}},
    "$defs": {"n": {"type": ["integer", "null"], "minimum": 0}},
}


@pytest.mark.parametrize("value, wrong", [
    ({"id": "x", "items": [1, None]}, []),
    ({"id": "x", "items": [1], "kind": None, "v": "1.0"}, []),
    ([], [("$", "not object")]),
    ({"id": "", "items": []}, [("$.id", "too short"), ("$.id", "does not fit pattern"), ("$.items", "too few items")]),
    ({"id": "x", "items": [-1, True, 1.5, -1]}, [("$.items", "items repeat"), ("$.items[0]", "below minimum"), ("$.items[1]", "not integer or null"), ("$.items[2]", "not integer or null"), ("$.items[3]", "below minimum")]),
    ({"items": [0], "kind": "b", "v": 1, "more": 2}, [("$", "id is missing"), ("$.kind", "not in enum"), ("$.v", "differs from const"), ("$.more", "unexpected")]),
])
def test_problems(value, wrong):
    assert validate.problems(value, SCHEMA) == wrong


def test_gate(spark):
    docs = spark.createDataFrame([(1, '{"id": "x", "items": [1]}', "a"), (2, "{", "b"), (3, None, "c"), (4, "{}", "d")], "k int, j string, path string")
    assert sorted(map(tuple, validate.schema_errors(docs, "k", "j", SCHEMA).collect())) == [(2, "$", "no JSON"), (3, "$", "no JSON"), (4, "$", "id is missing"), (4, "$", "items is missing")]
    assert [tuple(r) for r in validate.sound(docs, "k", "j", SCHEMA).collect()] == [(1, '{"id": "x", "items": [1]}', "a")]


def test_hybrid_clusters(spark):
    gold = spark.createDataFrame([("d", f"g{n}", "t", "character", "proper", 10 * n, 10 * n + 5, e) for n, e in enumerate(["ann", "ann", "bob", None])] + [("d", "late", "t", "x", "proper", 90, 95, "ann")], "doc string, id string, text string, type string, kind string, start int, end int, entity string")
    pred = spark.createDataFrame([("d", f"p{n}", "t", "character", "proper", s, s + 3) for n, s in enumerate([2, 50, 60, 70, 80])], "doc string, id string, text string, type string, kind string, start int, end int")
    cuts = hybrids.region_ends(spark.createDataFrame([("d", "x" * 99, 40), ("e", "xyz", None)], "doc string, text string, region_end int"))
    assert sorted(map(tuple, cuts.collect())) == [("d", 40), ("e", 3)]
    mixed = hybrids.hybrid_mentions(gold, pred, cuts)
    assert [(r.id, r.start, r.gold_id) for r in mixed.orderBy("start").collect()] == [("M1", 0, "g0"), ("M2", 10, "g1"), ("M3", 20, "g2"), ("M4", 30, "g3"), ("M5", 50, None), ("M6", 60, None), ("M7", 70, None), ("M8", 80, None)]
    # C1 goes to ann by two to one, C2 is a tie, C3 has no gold, C4 keeps nothing of its own
    members = spark.createDataFrame([("d", c, m) for c, ms in {"C1": ("M1", "M2", "M3", "M5"), "C2": ("M1", "M3", "M6"), "C3": ("M7", "M8"), "C4": ("M4",)}.items() for m in ms], "doc string, cluster string, id string")
    got = sorted((r.cluster, r.id, r.how) for r in hybrids.gold_clusters(mixed, members).collect())
    assert got == [("gold:ann", "M1", "gold"), ("gold:ann", "M2", "gold"), ("gold:ann", "M5", "joined"), ("pred:C3", "M7", "kept"), ("pred:C3", "M8", "kept")]
    added = mixed.union(mixed.where("id = 'M8'").selectExpr("doc", "text", "type", "kind", "1", "2", "gold_id", "entity", "'M9'"))
    left, sets = hybrids.without_added(added, members.union(spark.createDataFrame([("d", "C4", "M9")], members.schema)), cuts)
    assert left.count() == 8 and {r.cluster for r in sets.collect()} == {"C1", "C2", "C3"}


def test_naming_links(spark):
    text = "“My name is Mara,” she said. 😀 I'm\nTom. This is Averly. I know his name was Lee."
    at = lambda s: text.index(s)
    m = [("a", "My", "pronominal", "character", at("My")), ("b", "Mara", "proper", "character", at("Mara")), ("i", "I", "pronominal", "character", at("I'm")), ("j", "I", "pronominal", "character", at("I know")), ("t", "Tom", "proper", "character", at("Tom")), ("p", "Averly", "proper", "location", at("Averly")), ("h", "his", "pronominal", "character", at("his name")), ("l", "Lee", "proper", "character", at("Lee"))]
    mentions = spark.createDataFrame([("d", *r) for r in m], "doc string, id string, text string, kind string, type string, start int")
    members = spark.createDataFrame([("d", "C1", "a"), ("d", "C1", "b"), ("d", "C2", "j"), ("d", "C2", "i")], "doc string, cluster string, id string")
    texts = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "doc string, text string")
    assert sorted((r.a, r.b) for r in hybrids.naming_links(texts, mentions, members).collect()) == [("a", "b"), ("h", "l"), ("i", "t")]
    assert sorted((r.a, r.b) for r in hybrids.naming_links(texts, mentions, members.where("cluster = 'C1'")).collect()) == [("a", "b"), ("h", "l")]
