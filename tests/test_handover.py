"""Documents as integration rows, and those rows through the integration itself."""

import json

import pytest
from pyspark.sql import functions as F

from loreline.operators import handover, integrate
from loreline.sources.files import DOCUMENT

TEXT = "Mr. Vane met\nhis wife at Dunmore. Vane left; he sighed. The twins slept."
FULL = DOCUMENT.replace(", _corrupt_record", ", temporal_relations ARRAY<STRUCT<source_event_id: STRING, relation: STRING, target_event_id: STRING>>, _corrupt_record")


def doc(**changes):
    m = lambda i, text, kind, how: {"mention_id": i, "text": text, "type": kind, "mention_kind": how, "start": 0, "end": 1}
    e = lambda i, kind, start, *people: {"event_id": i, "type": kind, "start": start, "participants": [{"mention_id": p, "role": r} for p, r in people]}
    r = lambda i, p, a, b: {"relationship_id": i, "predicate": p, "subject_mention_id": a, "object_mention_id": b}
    f = lambda i, p, e, v: {"fact_id": i, "property": p, "entity_mention_id": e, "value": v}
    base = {
        "story_id": "s", "text": TEXT,
        "mentions": [
            m("M1", "Mr. Vane", "character", "proper"), m("M2", "his wife", "character", "nominal"), m("M3", "Dunmore", "location", "proper"), m("M4", "Vane", "character", "proper"), m("M5", "he", "character", "pronominal"),
            m("M6", "The twins", "character", "nominal"), m("M7", "lamp", "object", "nominal"), m("M8", "porter", "character", "nominal"), m("M9", "Dunmore", "location", "proper"), m("M10", "Lil", "character", "proper"),
        ],
        "coreference_clusters": [{"cluster_id": "C1", "mentions": ["M5", "M4", "M1"]}],
        "relationships": [r("R1", "MARRIED_TO", "M2", "M4"), r("R2", "PARENT_OF", "M1", "M10"), r("R3", "PARENT_OF", "M6", "M10"), r("R4", "MARRIED_TO", "M2", "M1"), r("R5", "KNOWS", "M8", "M6"), r("R6", "KNOWS", "M8", "gone")],
        "facts": [f("F1", "age", "M4", "40"), f("F2", "age", "M1", "41"), f("F3", "mood", "M7", "lit")],
        "events": [e("E1", "MEETING", 9, ("M1", "agent"), ("M2", "patient"), ("M4", "agent"), ("M6", "agent")), e("E2", "OTHER", 40), e("E3", "DEPARTURE", 36, ("M5", "agent"))],
        "temporal_relations": [{"source_event_id": "E1", "relation": "BEFORE", "target_event_id": "E3"}, {"source_event_id": "E1", "relation": "BEFORE", "target_event_id": "E2"}],
    }
    return base | changes


def same_names():
    m = lambda i, text, kind: {"mention_id": i, "text": text, "type": kind, "mention_kind": "proper"}
    return doc(
        story_id="names", coreference_clusters=[], relationships=[], events=[], temporal_relations=[], mentions=[m("A", "Robin", "character"), m("B", "Robin", "location"), m("C", "Sir Robin", "character")],
        facts=[{"fact_id": "F", "property": "age", "entity_mention_id": "B", "value": "3"}],
    )


EMPTY = ("mentions", "coreference_clusters", "relationships", "facts", "events", "temporal_relations")


@pytest.fixture(scope="module")
def got(spark):
    docs = [doc(), same_names(), doc(story_id="empty", **{k: [] for k in EMPTY}), doc(story_id="null", text=None, **dict.fromkeys(EMPTY))]
    return handover.rows_of(spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.from_json("j", FULL).alias("d")).select("d.*"))


def test_names_roles_and_relations(got):
    found = [(r.place, r.name, r.type, r.aliases, r.attributes) for r in got.of("s").entities.orderBy("place").collect()]
    assert found == [
        (0, "Vane", "character", ["Mr. Vane"], {"age": "40"}), (1, "Vane's wife", "character", [], {}), (2, "Dunmore", "location", [], {}), (3, "Lil", "character", [], {}),
    ]
    # the porter only knows a group of several, which is nobody; two words for one marriage are one relation
    assert sorted((r.subject, r.predicate, r.object) for r in got.of("s").relations.collect()) == [("Vane", "FATHER_OF", "Lil"), ("Vane's wife", "MARRIED_TO", "Vane")]
    assert {r.name: r.gender for r in got.of("s").evidence.collect()} == {"vane": "m", "vane's wife": "f", "dunmore": None, "lil": None}


def test_events_and_order(got):
    events = {r.id: (r.type, r.description, [(p.name, p.role) for p in r.participants]) for r in got.events.collect()}
    assert events == {"E1": ("MEETING", "Mr. Vane met his wife at Dunmore.", [("Vane", "AGENT"), ("Vane's wife", "PATIENT")]), "E3": ("DEPARTURE", "Vane left; he sighed.", [("Vane", "AGENT")])}
    assert [tuple(r)[1:] for r in got.temporal.collect()] == [("E1", "BEFORE", "E3")]


def test_two_groups_of_one_name_are_one_entity(got):
    assert [(r.name, r.type, r.attributes) for r in got.of("names").entities.orderBy("place").collect()] == [("Robin", "character", {"age": "3"}), ("Sir Robin", "character", {})]


def test_empty_documents(got):
    for t in (got.entities, got.relations, got.events, got.temporal, got.evidence):
        assert t.where("story_id IN ('empty', 'null')").count() == 0


def test_into_the_world(spark, got):
    g = got.of("s")
    state = integrate.integrate_chapter(integrate.empty_state(spark), 1, g.entities, g.relations, g.events, temporal=g.temporal, evidence=g.evidence)
    assert sorted(r.canonical_name for r in state.entities.collect()) == ["Dunmore", "Lil", "Vane", "Vane's wife"]
    assert {(r.relationship_type, r.status) for r in state.relations.collect()} == {("FATHER_OF", "ACTIVE"), ("MARRIED_TO", "ACTIVE")}
    assert state.events.count() == 2 and state.participants.count() == 3
