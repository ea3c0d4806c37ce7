"""Proposals of every kind in one table."""

from loreline.operators import proposals as P


def test_build(spark):
    df = spark.createDataFrame
    stored = df([("w", 1, "Mara Quinn"), ("w", 2, "Tom"), ("w", 3, "Eve"), ("v", 9, "Ned")], "world_id string, entity_id long, canonical_name string")
    aliases = df([(1, "Captain"), (3, "Evie")], "entity_id long, alias string")
    entities = df(
        [("j", "w", 1, " mara quinn ", "CHARACTER", ["Mara", "mara quinn", "captain"], {"age": "31", "eye_color": "Blue ", "origin": ""}), ("j", "w", 2, "Ned", None, ["The Cook", "Cookie"], {"age": "50"}), ("j", "w", 3, "Someone", "character", ["Evie"], None), ("j", "w", 4, " ", "x", None, None), ("k", "v", 1, "Ned", "Character", None, None)],
        "job string, world_id string, place long, name string, type string, aliases array<string>, attributes map<string,string>",
    )
    found = P.matches(entities, stored, aliases)
    assert {(r.job, r.place): r.entity_id for r in found.collect()} == {("j", 1): 1, ("j", 3): 3, ("k", 1): 9}
    relations = df(
        [("j", "w", 1, "Mara", "knows", "Tom"), ("j", "w", 2, "Tom", "FATHER_OF", "the cook"), ("j", "w", 3, "mara quinn", "KNOWS", "TOM"), ("j", "w", 4, "Tom", "KNOWS", "Mara"), ("j", "w", 5, "Tom", None, "Tom"), ("j", "w", 6, "Tom", "HATES", "Nobody"), ("j", "w", 7, "Evie", "ENEMY_OF", "Tom"), ("j", "w", 8, "Tom", "LOVES", "Eve")],
        "job string, world_id string, place long, subject string, predicate string, object string",
    )
    happened = df([("j", 1, 7, "They  met.\n"), ("j", 2, 7, "They parted."), ("j", 3, 7, " ")], "job string, place long, chapter_id long, description string")
    values = df([(1, "age", "30"), (1, "eye_color", "blue")], "entity_id long, property_name string, value string")
    types = df([(1, 2, "KNOWS"), (3, 2, "FRIEND_OF")], "source_id long, target_id long, relationship_type string")
    told = df([(7, "They met.")], "chapter_id long, description string")
    decided, rejected = df([], "entity_id long, property_name string, a string, b string"), df([(2, 3, "LOVES")], "source_id long, target_id long, predicate string")
    out = P.build(entities, relations, happened, found, stored, aliases, values, types, told, decided, rejected)
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])
    assert got == [
        ("j", "p-001", "entity", "known", 1, None, "mara quinn", "character", None, None, None),
        ("j", "p-002", "alias", "new", 1, None, "Mara", None, None, None, None),
        ("j", "p-003", "fact", "changed", 1, None, "age", "31", "30", None, None),
        ("j", "p-004", "fact", "known", 1, None, "eye_color", "Blue ", "blue", None, None),
        ("j", "p-005", "entity", "new", None, None, "Ned", "unknown", None, None, None),
        ("j", "p-006", "fact", "new", None, "p-005", "age", "50", None, None, None),
        ("j", "p-007", "entity", "known", 3, None, "Someone", "character", None, None, None),
        ("j", "p-008", "alias", "new", 3, None, "Someone", None, None, None, None),
        ("j", "p-009", "relationship", "known", 1, None, "KNOWS", None, "KNOWS", 2, None),
        ("j", "p-010", "relationship", "new", 2, None, "FATHER_OF", None, None, None, "p-005"),
        ("j", "p-011", "relationship", "known", 2, None, "KNOWS", None, "KNOWS", 1, None),
        ("j", "p-012", "relationship", "changed", 3, None, "ENEMY_OF", None, "FRIEND_OF", 2, None),
        ("j", "p-013", "event", "known", None, None, "They  met.", None, None, None, None),
        ("j", "p-014", "event", "new", None, None, "They parted.", None, None, None, None),
        ("k", "p-001", "entity", "known", 9, None, "Ned", "character", None, None, None),
    ]
    blocked = P.open_only(out.selectExpr("id", "change", "filter(array(ref, target_ref), r -> r IS NOT NULL) refs").where("id <> 'p-001'"), df([], "id string"))
    assert {r.id for r in blocked.collect()} == {"p-002", "p-003", "p-005", "p-008", "p-012", "p-014"}
