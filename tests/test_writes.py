"""Resolution, merging, integration, files and streams."""

import json
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loreline.operators import extraction, integrate, ledger, merge, resolve, spans
from loreline.sources import files
from loreline.streaming import chapters as stream


@pytest.fixture(scope="module")
def known(spark):
    e = spark.createDataFrame([(1, "Mara Quinn", "character"), (2, "Mr. Bennet's wife", "character"), (3, "Mrs. Hall", "character"), (4, "Elias Brandt", "character"), (5, "Port of Averly", "location"), (6, "Tobias Quinn", "character"), (7, "mother", "character")], "id int, canonical_name string, entity_type string")
    a = spark.createDataFrame([(1, "Red"), (4, "The Captain")], "entity_id int, alias string")
    return e, a


@pytest.mark.parametrize("names, kind, want", [
    (["Mara"], "character", (1, "part")), (["mara quinn"], "character", (None, "new")), (["MARA QUINN"], None, (1, "exact")), (["Red"], "character", (1, "exact")), (["Captain Elias Brandt"], "character", (4, "part")),
    (["Quinn"], "character", (None, "new")), (["mother"], "character", (None, "new")), (["Mrs. Bennet"], "character", (2, "implied")), (["Mr. Bennet's wife"], "character", (2, "owned")),
    (["Mrs. Hall's husband"], "character", (None, "new")), (["Mr. Hall's wife"], "character", (3, "owned")), (["Mr. Hall"], "character", (None, "new")), (["Averly"], "location", (5, "part")), (["Averly"], "character", (None, "new")),
])
def test_resolve(spark, known, names, kind, want):
    i = spark.createDataFrame([(1, names, kind)], "mention_id int, names array<string>, entity_type string")
    assert tuple(resolve.resolve(i, *known).select("entity_id", "how").first()) == want


def test_evidence_vetoes(spark, known):
    i = spark.createDataFrame([(1, ["Mrs. Brandt"], "character")], "mention_id int, names array<string>, entity_type string")
    got = lambda ev: resolve.resolve(i, *known, spark.createDataFrame(ev, "name string, gender string")).first().entity_id
    assert got([("x", "f")]) is None and got([("Elias Brandt", "f")]) == 4 and got([("Elias Brandt", "m")]) is None


def test_merge(spark):
    pairs = spark.createDataFrame([(2, 1)], "source_id int, target_id int")
    e = spark.createDataFrame([(1, "Captain"), (2, "Ilse Rook"), (3, "Tomas")], "id int, canonical_name string")
    a = spark.createDataFrame([(2, "captain "), (2, "Rook"), (1, "ROOK")], "entity_id int, alias string")
    assert sorted((r.entity_id, r.alias) for r in merge.aliases(e, a, pairs).collect()) == [(1, "Ilse Rook"), (1, "ROOK")]
    f = spark.createDataFrame([(1, 1, "Role", "a", "ACTIVE"), (2, 2, "role ", "a", "ACTIVE"), (3, 2, "age", "3", "ACTIVE")], "version_id int, entity_id int, property_name string, value string, status string")
    assert {r.version_id: (r.entity_id, r.status) for r in merge.facts(f, pairs).collect()} == {1: (1, "ACTIVE"), 2: (1, "SUPERSEDED"), 3: (1, "ACTIVE")}
    p = spark.createDataFrame([(9, 1, "agent"), (9, 2, "target"), (8, 2, "agent")], "event_id int, entity_id int, role string")
    assert sorted((r.event_id, r.entity_id, r.role) for r in merge.participants(p, pairs).collect()) == [(8, 1, "agent"), (9, 1, "agent")]
    r = spark.createDataFrame([(1, 1, 2, "KNOWS", "ACTIVE"), (2, 1, 3, "KNOWS", "ACTIVE"), (3, 2, 3, "OWNS", "ACTIVE"), (4, 3, 2, "KNOWS", "ACTIVE"), (5, 3, 3, "KNOWS", "ACTIVE")], "version_id int, source_id int, target_id int, relationship_type string, status string")
    got = {x.version_id: (x.source_id, x.target_id, x.status) for x in merge.relations(r, pairs).collect()}
    assert got == {2: (1, 3, "ACTIVE"), 3: (1, 3, "SUPERSEDED"), 4: (3, 1, "ACTIVE"), 5: (3, 3, "ACTIVE")}
    jobs = spark.createDataFrame([(7, "queued")], "world_id int, status string")
    w = e.withColumn("world_id", F.when(F.col("id") < 3, 7).otherwise(8))
    bad = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 99)], "source_id int, target_id int")
    assert sorted(x.reason for x in merge.check(bad, w, jobs).collect()) == ["a job is running", "not found in this world", "not found in this world", "same entity"]


def chapter(spark, state, n, people, rels=(), events=()):
    e = spark.createDataFrame([(i, name, "character", al, at) for i, (name, al, at) in enumerate(people)], "place int, name string, type string, aliases array<string>, attributes map<string,string>")
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rels)], "place int, subject string, predicate string, object string")
    v = spark.createDataFrame(list(events), "type string, description string")
    return integrate.integrate_chapter(state, n, e, r, v)


def test_integration(spark):
    s0 = integrate.empty_state(spark)
    s1 = chapter(spark, s0, 1, [("Mara Quinn", ["Red"], {"eye_color": "grey", "status": "alive"}), ("Tomas", [], {"status": ""})], [("Mara Quinn", "friend of", "Tomas"), ("Mara Quinn", "KNOWS", "Nobody")], [("MEETING", "They met."), ("MEETING", " They  met.")])
    assert integrate.counters(s0, s1, 1) == {"entities_created": 2, "entities_updated": 0, "facts_added": 2, "relationships_added": 1, "events_added": 1, "contradictions_found": 0}
    s2 = chapter(spark, s1, 2, [("Mara", [], {"eye_color": "green", "status": "dead"}), ("Tomas", ["Tom"], {})], [("Mara", "ENEMY_OF", "Tom")])
    assert integrate.counters(s1, s2, 2) == {"entities_created": 0, "entities_updated": 2, "facts_added": 2, "relationships_added": 1, "events_added": 0, "contradictions_found": 2}
    facts = {(r.property_name, r.value): r.status for r in s2.facts.collect()}
    assert facts == {("eye_color", "grey"): "ACTIVE", ("eye_color", "green"): "CONTRADICTED", ("status", "alive"): "SUPERSEDED", ("status", "dead"): "ACTIVE"}
    assert sorted(r.alias for r in s2.aliases.collect()) == ["Mara", "Red", "Tom"]
    again = chapter(spark, s2, 2, [("Mara", [], {"eye_color": "green", "status": "dead"}), ("Tomas", ["Tom"], {})], [("Mara", "ENEMY_OF", "Tom")])
    assert sorted(map(tuple, again.facts.collect())) == sorted(map(tuple, s2.facts.collect()))


def test_all_rules_judge_what_is_written(spark):
    """Ages, deaths, a second father, cycles, and chapters that come late; decided claims are not recorded again."""
    s = integrate.empty_state(spark)
    s = chapter(spark, s, 1, [("Ann", [], {"age": "30", "status": "alive"}), ("Bert", [], {"status": "dead"}), ("Carl", [], {})], [("Bert", "FATHER_OF", "Ann")])
    late = chapter(spark, s, 5, [("Ann", [], {"age": "twenty-five"}), ("Bert", [], {"status": "still alive"})], [("Carl", "father of", "Ann"), ("Carl", "FATHER_OF", "Bert")])
    assert integrate.counters(s, late, 5) == {"entities_created": 0, "entities_updated": 2, "facts_added": 2, "relationships_added": 2, "events_added": 0, "contradictions_found": 3}
    assert sorted((r.rule_id, r.confidence) for r in late.contradictions.collect()) == [("AGE_MONOTONIC", 0.7), ("DEAD_THEN_ALIVE", 0.7), ("RELATIONSHIP_SINGLE_SOURCE", 0.6)]
    assert {(r.value, r.status) for r in late.facts.where("chapter_number = 5").collect()} == {("twenty-five", "CONTRADICTED"), ("still alive", "CONTRADICTED")}
    assert sorted(r.status for r in late.relations.collect()) == ["ACTIVE", "ACTIVE", "CONTRADICTED"]
    between = chapter(spark, late, 3, [("Ann", [], {"age": "31"})])
    assert {(r.value, r.status) for r in between.facts.where("property_name = 'age'").collect()} == {("30", "SUPERSEDED"), ("31", "ACTIVE"), ("twenty-five", "CONTRADICTED")}
    decided = replace(late, contradictions=late.contradictions.withColumn("status", F.lit("DISMISSED")))
    again = chapter(spark, decided, 6, [("Ann", [], {"age": "25"}), ("Bert", [], {"status": "STILL ALIVE"})], [("Carl", "FATHER_OF", "Ann")])
    assert integrate.counters(decided, again, 6)["contradictions_found"] == 1  # another spelling of the age is another claim
    assert again.facts.where("chapter_number = 6 AND status = 'CONTRADICTED'").count() == 2


def test_events_participants_and_cycles(spark):
    e = spark.createDataFrame([(0, "Ann", "character", ["Annie"], {}, "she")], "place int, name string, type string, aliases array<string>, attributes map<string,string>, mention string")
    r = spark.createDataFrame([], "place int, subject string, predicate string, object string")
    v = spark.createDataFrame([("a", "TRAVEL", "Ann left", [("annie", "agent"), ("Nobody", "agent")]), ("b", None, "Ann came", [("Ann", None)])], "id string, type string, description string, participants array<struct<name:string,role:string>>")
    t = spark.createDataFrame([("a", "BEFORE", "b"), ("a", "after", "b"), ("a", "BEFORE", "gone")], "event_1 string, relation string, event_2 string")
    s0 = integrate.empty_state(spark)
    s1 = integrate.integrate_chapter(s0, 1, e, r, v, "w", t)
    assert integrate.counters(s0, s1, 1) == {"entities_created": 1, "entities_updated": 0, "facts_added": 0, "relationships_added": 0, "events_added": 2, "contradictions_found": 1}
    assert sorted(x.role for x in s1.participants.collect()) == ["AGENT", "PARTICIPANT"] and s1.mentions.first().surface_text == "she"
    assert {x.event_type for x in s1.events.collect()} == {"TRAVEL", "EVENT"} and s1.contradictions.first().event_refs == ["a", "b"]
    s2 = integrate.integrate_chapter(s1, 1, e, r, v, "w", t)
    assert set(integrate.counters(s1, s2, 1).values()) == {0}


def test_ledger(spark):
    facts = spark.createDataFrame([(1, 7, "age", "30", "ACTIVE"), (2, 7, "age", " 25", "CONTRADICTED"), (3, 8, "age", "30", "ACTIVE")], "version_id int, entity_id int, property_name string, value string, status string")
    rels = spark.createDataFrame([(1, "a", "c", "FATHER_OF", "ACTIVE"), (2, "b", "c", "FATHER_OF", "CONTRADICTED"), (3, "a", "c", "father_of ", "SUPERSEDED")], "version_id int, source_id string, target_id string, relationship_type string, status string")
    events = spark.createDataFrame([(1, 1, "MEETING", "They  met"), (2, 1, "MEETING", "they met ")], "event_id int, chapter_number int, event_type string, description string")
    rows = [(1, 1, 2, None, None, None, None), (2, 2, 1, None, None, None, None), (3, 1, 3, None, None, None, None), (4, None, None, 1, 2, None, None), (5, None, None, 2, 3, None, None), (6, None, None, None, None, 1, None), (7, None, None, None, None, 2, 1), (8, None, None, None, None, 9, None)]
    c = spark.createDataFrame(rows, "id int, old_fact_version_id int, new_fact_version_id int, old_relationship_version_id int, new_relationship_version_id int, event_id_a int, event_id_b int")
    got = {r.id: (r.family, r.signature) for r in ledger.signatures(c, facts, rels, events).collect()}
    assert got[1] == got[2] and got[4] == got[5] and got[6] == got[7] and got[3] == got[8] == (None, None) and len({got[1], got[4], got[6]}) == 3
    decided = ledger.signatures(c.where("id = 4"), facts, rels, events)
    assert [r.claim.split("\u0001")[0] for r in ledger.rejected_relations(decided, rels).collect()] == ["b"]
    k = spark.createDataFrame([(1, 1, 2, "DETECTED"), (2, 1, 3, "DETECTED")], "id int, old_version_id int, new_version_id int, status string")
    pick = spark.createDataFrame([(1, 2, None), (2, 9, None), (5, 1, None)], "id int, preferred_id int, status string")
    assert {(r.id, r.reason) for r in ledger.resolution_errors(k, pick).collect()} == {(2, "not one of the two"), (5, "unknown contradiction")}
    after, versions = ledger.resolved(k, facts, pick)
    assert {r.id: r.status for r in after.collect()} == {1: "RESOLVED", 2: "DETECTED"} and {r.version_id: r.status for r in versions.collect()} == {1: "SUPERSEDED", 2: "ACTIVE", 3: "ACTIVE"}
    new = spark.createDataFrame([("R", None, None, "x"), ("R", None, None, "y"), ("R", 1, None, "z"), ("R", 1, None, "w")], "rule_id string, a int, b int, explanation string")
    assert sorted((r.a or 0, r.explanation in "zw") for r in ledger.recorded_once(new, new.where("explanation = 'x'"), ["a", "b"]).collect()) == [(0, False), (1, True)]
    flat = spark.createDataFrame([("eye_color", "grey", "Green"), ("age", "1", "2"), ("eye_color", " grey", "GREY"), ("eye_color", None, "x")], "p string, a string, b string")
    assert [r[0] for r in flat.select(ledger.fact_conflict(F.col("p"), F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_sources_of_contradictions(spark):
    df = spark.createDataFrame
    chapters = df([(10, 1, "It rained.\nShe was 30 then. Ann was 30 still."), (20, 1, "Ann was 31. Bo was 30."), (30, 2, None)], "chapter_id int, chapter_number int, text string")
    facts = df([(1, 7, 10, "30"), (2, 7, 20, "31"), (3, 7, None, "32"), (4, 7, 10, "99"), (5, 7, 30, "30"), (6, 8, 20, "30")], "version_id int, entity_id int, chapter_id int, value string")
    names = df([(7, ["Ann", "Miss Ann"]), (8, ["Bo"])], "entity_id int, names array<string>")
    found = df([(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, None, 1)], "id int, old_version_id int, new_version_id int")
    got = {(r.id, r.side): (r.chapter_id, r.line, r.sentence, r.label) for r in ledger.sources(found, facts, chapters, names).collect()}
    assert got == {
        (1, "old"): (10, 2, "Ann was 30 still.", "Chapter 1 · line 2"), (1, "new"): (20, 1, "Ann was 31.", "Chapter 1 · line 1"), (2, "old"): (None, None, None, "Added manually"), (2, "new"): (10, None, None, "Chapter 1"),
        (3, "old"): (30, None, None, "Chapter 2"), (3, "new"): (20, 1, "Bo was 30.", "Chapter 1 · line 1"), (4, "new"): (10, 2, "Ann was 30 still.", "Chapter 1 · line 2"),
    }
    ties = df([(1, 7, 8, 20), (2, 8, 7, 10)], "version_id int, source_id int, target_id int, chapter_id int")
    told = {r.side: r.sentence for r in ledger.relation_sources(df([(1, 1, 2)], "id int, old_version_id int, new_version_id int"), ties, df([(20, 1, "Ann slept. Bo met Ann.")], "chapter_id int, chapter_number int, text string"), names).collect()}
    assert told == {"old": "Bo met Ann.", "new": None}


def test_align_is_greedy_and_one_to_one(spark):
    p = spark.createDataFrame([("d", "p1", 0, 10), ("d", "p2", 5, 9), ("d", "p3", 20, 21)], "doc string, id string, start int, end int")
    g = spark.createDataFrame([("d", "g1", 4, 9), ("d", "g2", 0, 4), ("d", "g3", 30, 31)], "doc string, id string, start int, end int")
    assert sorted((r.pred_id, r.gold_id) for r in spans.align(p, g, ["doc"]).collect()) == [("p1", "g1")]
    assert spans.overlapping(p, g, ["doc"], 2).count() == 3


def test_mentions_and_clusters(spark):
    f = spark.createDataFrame([(1, 0, 4, "object", 0.6, "proper", 0), (1, 0, 4, "character", 0.9, "proper", 1), (1, 5, 7, "character", 0.9, "pronominal", 2), (1, 8, 12, "location", 0.7, "proper", 3), (1, 8, 12, "object", 0.7, "proper", 4)], "doc_id int, start int, end int, type string, confidence double, kind string, seen int")
    assert [(r.mention_id, r.type) for r in extraction.build_mentions(f).orderBy("start").collect()] == [("M1", "character"), ("M2", "location")]
    m = spark.createDataFrame([(1, "a", "Mara", "c", "proper", 0, 1), (1, "b", "she", "c", "pronominal", 2, 3), (1, "c", "MARA", "c", "proper", 4, 5), (1, "d", "she", "c", "pronominal", 6, 7), (1, "e", "x", "c", "proper", 8, 9)], "doc_id int, mention_id string, text string, type string, kind string, start int, end int")
    c = spark.createDataFrame([(1, "b", "k"), (1, "c", "k")], "doc_id int, mention_id string, cluster string")
    none = spark.createDataFrame([], "doc_id int, a string, b string")
    got = extraction.merge_clusters(m, c, none)
    assert sorted((r.mention_id, r.cluster_id) for r in got.collect()) == [("a", "C1"), ("b", "C1"), ("c", "C1")]
    assert {r.mention_id: r.entity for r in extraction.with_singletons(m, got).collect()}["d"] == "d"


def test_events_from_tokens(spark):
    # Mara and Tom walked to Hale before Jo fell
    words = [("Mara", "PROPN", "nsubj", 3), ("and", "CC", "cc", 0), ("Tom", "PROPN", "conj", 0), ("walked", "VERB", "ROOT", 3), ("to", "ADP", "prep", 3), ("Hale", "PROPN", "pobj", 4), ("before", "SCONJ", "mark", 8), ("Jo", "PROPN", "nsubj", 8), ("fell", "VERB", "advcl", 3)]
    lemma = {"walked": "walk", "fell": "fall"}
    rows, at, mentions = [], 0, []
    for i, (w, pos, rel, head) in enumerate(words):
        rows.append((1, i, w, lemma.get(w, w.lower()), pos, rel, head, at, at + len(w), pos == "VERB"))
        if pos == "PROPN":
            mentions.append((1, w, "location" if w == "Hale" else "character", at, at + len(w)))
        at += len(w) + 1
    t = spark.createDataFrame(rows, "doc_id int, token_id int, word string, lemma string, pos string, rel string, head int, start int, end int, event boolean")
    m = spark.createDataFrame(mentions, "doc_id int, mention_id string, type string, start int, end int")
    e = extraction.find_events(t)
    assert {(r.word, r.type) for r in e.collect()} == {("walked", "TRAVEL"), ("fell", "OTHER")}
    assert {(r.token_id, r.role, r.mention_id) for r in extraction.participants(e, t, m).collect()} == {(3, "agent", "Mara"), (3, "agent", "Tom"), (3, "location", "Hale"), (8, "agent", "Jo")}
    assert [(r.source, r.relation, r.target) for r in extraction.temporal_relations(e, t).collect()] == [(3, "BEFORE", 8)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    assert files.read_manuscripts(spark, str(tmp_path / "a.txt"), "txt").first().text == "café �"
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>T</w:t><w:t>wo</w:t></w:r></w:p></w:body></w:document>')
    assert files.read_manuscripts(spark, str(tmp_path / "b.docx"), "docx").first().text == "One\nTwo"
    with pytest.raises(files.UnsupportedFormat):
        files.read_manuscripts(spark, "x", "pdf")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "ch1.json").write_text(json.dumps({"story_id": "s", "text": "t", "mentions": [{"mention_id": "M1", "text": "t", "type": "other", "start": 0, "end": 1}]}, indent=1))
    docs = files.read_documents(spark, str(tmp_path / "d"), "ch*.json")
    assert docs.first().mentions[0].mention_id == "M1"
    empty = files.with_predictions(docs, docs.where("false")).first().pred
    assert empty.mentions == [] and empty.facts == [] and empty.text is None
    (tmp_path / "q.csv").write_text("id,l\n1,\"['a', 'b c']\"\n2,nan\n3,\n")
    assert [r.l for r in files.read_lists(spark, str(tmp_path / "q.csv"), ["l"]).orderBy("id").collect()] == [["a", "b c"], [], []]
    assert files.read_job(spark, str(tmp_path / "none"), "j", "job_id string").count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "chapter_number int, text string").write.parquet(src)
    seen = []
    rows = spark.readStream.schema("chapter_number int, text string").parquet(src)
    stream.in_order(rows, lambda n, df: seen.append((n, df.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(1, 1), (2, 1), (3, 1)]
    ev = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    q = stream.windowed_counts(ev).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
