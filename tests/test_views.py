"""Answers, searches, stores and job writes on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from loreline.functions import answers as A
from loreline.functions import scalars as S
from loreline.operators import views, writes
from loreline.sources import files


def column(spark, rows, schema, made):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(made).collect()]


def test_values(spark):
    rows = [("title", "Captain"), ("title", "lady"), ("title", "Mrs."), ("title", "Capt."), ("age", "thirty-one"), ("age", "child"), ("age", "5"), ("origin", "native place"), ("origin", "of Derby"), ("birth_place", "this workhouse"), ("birth_place", "workhouse"), ("species", "x")]
    assert column(spark, rows, "p string, v string", A.plausible(F.col("p"), F.col("v"))) == [True, False, False, True, True, False, True, False, True, True, False, True]
    rows = [("origin", "in the mill", 7), ("origin", "in mill", 3), ("age", "the mill", 4), ("birth_place", "a mill", 2), ("origin", "mill", 0)]
    assert column(spark, rows, "p string, t string, s int", A.with_determiner(F.col("p"), F.col("t"), F.col("s"))) == [3, 3, 4, 0, 0]
    rows = [("hair_color", "moppy dark"), ("eye_color", "human"), ("eye_color", "pale, very blue eyes"), ("occupation", "104.6 F.M."), ("age", "31"), ("occupation", "vet"), ("hair_color", "darken")]
    assert column(spark, rows, "p string, v string", A.fact_value(F.col("p"), F.col("v"))) == ["dark", None, "pale, very blue", None, "31", "vet", None]
    assert column(spark, [("7",), ("-3",), ("1.5",), ("x",), (None,)], "v string", A.whole_number(F.col("v"))) == [7, -3, None, None, None]
    assert column(spark, [(" the  mill. ",), ("N/A",), ("na;",), ("",), (None,)], "v string", S.answer_value(F.col("v"))) == ["the mill", None, None, None, None]


def test_relations(spark):
    text = "Old Mara is a friend of Tom. I work for Mr. Hale (again)."
    rows = [("Mara is a friend of Tom", "FRIEND_OF", "mara", "TOM"), ("Mara is a friend of Tom", "ENEMY_OF", "Mara", "Tom"), ("Mara was a friend of Tom", "FRIEND_OF", "Mara", "Tom"), ("I work for Mr. Hale (again)", "WORKS_FOR", "me", "Mr. Hale"), ("I work for Mr. Hale (again)", "WORKS_FOR", "me", "Ale"), (" ", "KNOWS", "a", "b"), ("friend of Tom", "FRIEND_OF", "om", "Tom")]
    made = A.states_relation(F.col("e"), F.lit(text), F.col("p"), F.col("a"), F.col("b"))
    assert column(spark, rows, "e string, p string, a string, b string", made) == [True, False, False, True, False, False, False]
    options = A.relation_options(F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    rows = [("Ann", "Bo", "character", "character"), ("Ann", "Hale", "character", "location"), ("Hale", "Rook", "location", "location")]
    sizes = column(spark, rows, "a string, b string, x string, y string", F.transform(options, lambda o: o["phrase"]))
    assert len(sizes[0]) == 20 and sizes[1] == ["Ann owns Hale"] and sizes[2] == ["Hale owns Rook", "Rook owns Hale"]
    rows = [("Ann", "Bo", "c", "c", " bo WORKS for ann "), ("Ann", "Bo", "c", "c", "none")]
    chosen = A.chosen_relation(F.col("z"), options)
    assert [r and (r.predicate, r.a_first) for r in column(spark, rows, "a string, b string, x string, y string, z string", chosen)] == [("WORKS_FOR", False), None]


def test_lines_and_settings(spark):
    rows = [("Ann", "character", ["Annie", "A."], [("eye_color", "grey"), ("age", "3")]), ("Hale", "location", [], [])]
    made = A.described(F.col("n"), F.col("k"), F.col("a"), F.col("f"))
    assert column(spark, rows, "n string, k string, a array<string>, f array<struct<property:string,value:string>>", made) == ["Ann (character) \u2014 also called Annie, A. \u2014 eye color: grey; age: 3", "Hale (location)"]
    text = "then Doctor Hanna met Captain Elias and Capt. Ray and Mr. Lee"
    rows = [(text.index(m), m) for m in ("Hanna", "Captain Elias", "Ray", "Lee", "Captain")]
    got = column(spark, rows, "s int, m string", A.title_fact(F.lit(text), F.col("s"), F.col("m")))
    assert [r and tuple(r) for r in got] == [("occupation", "doctor"), ("title", "Captain"), ("title", "Captain"), None, None]
    rows = [(" " + "x" * 200, {"chat_reply_length": "long", "odd": "1"}), (None, None)]
    got = column(spark, rows, "n string, p map<string,string>", A.profile(F.col("n"), F.col("p")))
    assert len(got[0].display_name) == 119 or len(got[0].display_name) == 120
    assert got[0].preferences == {"chat_reply_length": "long", "review_preselect_new": "true"} and got[1].preferences["chat_reply_length"] == "medium" and got[1].display_name == ""
    assert column(spark, [("long",), ("huge",), (None,)], "v string", A.reply_length_error(F.col("v")).isNull()) == [True, False, True]
    rows = [({"facts": ("partial", 3, None)}, "abcdef"), ({"facts": ("exhaustive", None, None)}, "x"), ({}, "x")]
    got = column(spark, rows, "l map<string,struct<coverage:string,start:int,end:int>>, t string", A.layer_scope(F.col("l"), "facts", F.col("t")))
    assert [(g.coverage, g.region and tuple(g.region)) for g in got] == [("partial", (3, 6)), ("exhaustive", None), ("none", None)]
    assert len(set(column(spark, [("a", "b"), ("a", "b"), ("ab", "")], "x string, y string", A.request_key(F.col("x"), F.col("y"))))) == 2


def test_sentences(spark):
    s = spark.createDataFrame([(1, 0, 0, 9, "Ann\n left."), (1, 1, 10, 20, "Old  Bo (x)")], "doc int, sentence int, start int, end int, text string")
    at = views.sentence_at(spark.createDataFrame([(1, 0), (1, 9), (1, 12), (2, 0)], "doc int, at int"), s, "doc")
    assert {(r.doc, r.at): r.text for r in at.collect()} == {(1, 0): "Ann left.", (1, 9): None, (1, 12): "Old Bo (x)", (2, 0): None}
    v = spark.createDataFrame([(1, 1, "ann LEFT."), (2, 1, "bo (X)"), (3, 1, "gone"), (4, 1, " ")], "id int, doc int, value string")
    assert {r.id: (r.sentence, r.start, r.end) for r in views.sentence_with(v, s, "doc").collect()} == {1: (0, 0, 10), 2: (1, 15, 21), 3: (None, None, None), 4: (None, None, None)}
    rows = [("I\n\n IN WHICH WE MEET \nAnn", ), ("I\nAnn left\nLOUD",), ("I\n123\n",), ("I",), (None,)]
    assert column(spark, rows, "t string", views.chapter_title(F.col("t"))) == ["IN WHICH WE MEET", None, None, None, None]
    gold = spark.createDataFrame([(1, "d", "e", "p", "the Mill"), (2, "d", "e", "q", "x"), (3, "d", "f", "p", "y")], "id int, doc string, entity string, property string, value string")
    given = spark.createDataFrame([("d", "e", "p", "old the  mill", "kept"), ("d", "e", "p", "THE MILL", "kept"), ("d", "e", "q", "x", "invalid"), ("d", "f", "p", None, "none")], "doc string, entity string, property string, value string, result string")
    assert [tuple(r) for r in views.answer_quality(gold, given).collect()] == [("d", 3, 2, 1)]
    assert column(spark, [(" A@b.c", "a@B.C "), ("a", "b")], "x string, y string", views.same_address(F.col("x"), F.col("y"))) == [True, False]


def test_job_writes(spark):
    runs = spark.createDataFrame([(1, 7, "PENDING", None, None), (2, 7, "DONE", None, "w0"), (3, 7, "PROCESSING", None, "w0"), (4, 8, "PENDING", None, None)], "run_id int, job_id int, status string, error string, worker string")
    got = lambda df: {r.run_id: (r.status, r.worker, r.error) for r in df.collect()}
    assert got(writes.claim(runs, 1, "w1"))[1] == ("PROCESSING", "w1", None) and got(writes.claim(runs, 2, "w1"))[2] == ("DONE", "w0", None)
    assert {i: s for i, (s, *_) in got(writes.fail_pending(runs, 7, "x")).items()} == {1: "FAILED", 2: "DONE", 3: "FAILED", 4: "PENDING"}
    results = spark.createDataFrame([(2, "FAILED", "late"), (3, "DONE", None)], "run_id int, status string, error string")
    assert {i: s for i, (s, *_) in got(writes.finish(runs, results)).items()} == {1: "PENDING", 2: "DONE", 3: "DONE", 4: "PENDING"}
    assert writes.run_chapter(lambda: None, "DONE")[0] == "skipped" and writes.run_chapter(lambda: None, "PENDING")[0] == "DONE" and writes.run_chapter(lambda: 1 / 0, "PENDING") == ("FAILED", "ZeroDivisionError: division by zero")
    stored = spark.createDataFrame([(1, "ACTIVE", 1.0, "x")], "id int, status string, confidence double, note string")
    rows = spark.createDataFrame([(1, "OLD"), (2, None)], "id int, status string")
    assert sorted(map(tuple, writes.append(stored, rows, "id").collect())) == [(1, "ACTIVE", 1.0, "x"), (2, "ACTIVE", 1.0, None)]
    heads, chapters = writes.upload(spark.createDataFrame([(1, "Chapter 1\nAnn.\n\nChapter 2: Two\nBo."), (2, None)], "manuscript_id int, text string"))
    assert heads.count() == 2 and sorted((r.chapter_id, r.version_number) for r in chapters.collect()) == [("1-1", 1), ("1-2", 1), ("2-1", 1)]


def test_stores(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = spark.createDataFrame([("../a/b.txt", "s", "one"), ("c.txt", "s", "two")], "name string, salt string, content string")
    files.write_contents(rows, at)
    files.write_contents(rows.limit(1).withColumn("content", F.lit("new")), at)
    stored = spark.read.parquet(at)
    name = next(r.stored for r in stored.collect() if r.stored.endswith("_b.txt"))
    assert stored.count() == 2 and "/" not in name and files.stored_text(stored, name) == "new"
    with pytest.raises(FileNotFoundError):
        files.stored_text(stored, "gone")
    assert files.delete_stored(spark, at, name) and not files.delete_stored(spark, at, name) and spark.read.parquet(at).count() == 1
    p = spark.createDataFrame([(1, "Ann", {"a": "1", "b": "2"})], "user_id int, display_name string, preferences map<string,string>")
    c = spark.createDataFrame([(1, None, {"b": "3"}), (2, " Bo ", None)], "user_id int, display_name string, preferences map<string,string>")
    files.save_profiles(p, c, f"{at}-p")
    assert {r.user_id: (r.display_name, r.preferences) for r in spark.read.parquet(f"{at}-p").collect()} == {1: ("Ann", {"a": "1", "b": "3"}), 2: ("Bo", {})}
    docs, issues = spark.createDataFrame([("s1", "x"), ("s2", "y")], "story_id string, text string"), spark.createDataFrame([("s1", "odd")], "story_id string, issue string")
    files.write_reviewed(docs, issues, f"{at}-r")
    assert spark.read.json(f"{at}-r/documents").count() == 2 and spark.read.text(f"{at}-r/issues").first().value == "odd"
    asked = spark.createDataFrame([("q1",), ("q2",)], "prompt string")
    cache = spark.createDataFrame([], "key string, answer string")
    todo = files.missing_requests(asked, cache).withColumn("answer", F.lit(json.dumps({"a": 1})))
    files.stored_requests(todo, cache, f"{at}-q")
    assert files.missing_requests(asked, spark.read.parquet(f"{at}-q")).count() == 0
