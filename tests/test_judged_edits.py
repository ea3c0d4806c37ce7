"""Manual additions under the rules: what is clean supersedes, what is found against changes nothing else."""

from loreline.operators import edits

FACTS = "version_id string, entity_id string, property_name string, value string, chapter_number int, created_at double"
RELATIONS = "version_id string, source_id string, target_id string, relationship_type string, chapter_number int, created_at double"


def test_judged_facts(spark):
    stored = spark.createDataFrame([("v1", "a", "eye_color", "blue", 1, 1.0, "ACTIVE"), ("v2", "a", "age", "30", 1, 1.0, "ACTIVE"), ("v3", "a", "mood", "sad", 1, 1.0, "SUPERSEDED"), ("v4", "a", "mood", "glad", 2, 2.0, "ACTIVE"), ("v5", "b", "eye_color", "grey", 1, 1.0, "ACTIVE"), ("v6", None, "age", "3", 1, 1.0, "ACTIVE")], FACTS + ", status string")
    added = spark.createDataFrame([("n1", "a", "eye_color", "green", None, 5.0), ("n2", "a", "eye_color", "Blue", None, 6.0), ("n3", "a", "age", "20", 4, 5.0), ("n4", "a", "mood", "glad", None, 5.0), ("n5", "a", "mood", "calm", None, 6.0), ("n6", "c", "mood", "new", None, 5.0), ("v5", "b", "eye_color", "red", None, 9.0)], FACTS)
    after, found = edits.judged_facts(stored, added)
    assert {r.version_id: r.status for r in after.collect()} == {
        "v1": "SUPERSEDED", "n1": "CONTRADICTED", "n2": "ACTIVE", "v2": "ACTIVE", "n3": "CONTRADICTED", "v3": "SUPERSEDED", "v4": "SUPERSEDED", "n4": "SUPERSEDED", "n5": "ACTIVE", "n6": "ACTIVE", "v5": "ACTIVE", "v6": "ACTIVE",
    }
    assert after.count() == 12 and {(r.version_id, r.rule_id, r.old_version_id) for r in found.collect()} == {("n1", "IMMUTABLE_FACT", "v1"), ("n3", "AGE_MONOTONIC", "v2")}


def test_judged_relations(spark):
    stored = spark.createDataFrame([("v1", "a", "b", "FRIEND_OF", 1, 1.0, "ACTIVE"), ("v2", "x", "y", "FATHER_OF", 1, 1.0, "ACTIVE"), ("v3", "p", "q", "KNOWS", 1, 1.0, "ACTIVE")], RELATIONS + ", status string")
    rows = [("n1", "a", "b", " friend_of ", 5.0), ("n2", "a", "b", "ENEMY_OF", 6.0), ("n3", "a", "b", "MARRIED_TO", 7.0), ("n4", "a", "b", "married_to", 8.0), ("n5", "z", "y", "FATHER_OF", 5.0), ("n6", "b", "a", "ENEMY_OF", 5.0), ("n7", "a", "b", "  ", 5.0)]
    added = spark.createDataFrame([(i, s, t, r, None, at) for i, s, t, r, at in rows], RELATIONS)
    after, found, refused = edits.judged_relations(stored, added)
    assert {r.version_id: r.status for r in after.collect()} == {"v1": "SUPERSEDED", "n2": "CONTRADICTED", "n3": "ACTIVE", "v2": "ACTIVE", "n5": "CONTRADICTED", "n6": "ACTIVE", "v3": "ACTIVE"}
    assert {(r.version_id, r.rule_id) for r in found.collect()} == {("n2", "RELATIONSHIP_INCOMPATIBLE"), ("n5", "RELATIONSHIP_SINGLE_SOURCE")}
    assert {r.version_id for r in refused.collect()} == {"n1", "n4", "n7"}


def test_nothing_added(spark):
    stored = spark.createDataFrame([("v1", "a", "b", "FRIEND_OF", 1, 1.0, "ACTIVE")], RELATIONS + ", status string")
    after, found, refused = edits.judged_relations(stored, spark.createDataFrame([], RELATIONS))
    assert (after.count(), found.count(), refused.count()) == (1, 0, 0)
