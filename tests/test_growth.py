"""Steps that must grow no faster than their input: what meets what, and what is carried along."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from loreline import plans
from loreline.operators import extraction, graph, hybrids, linking, texts, views
from loreline.plans import aggregates, entities, scores, tables
from loreline.sources import shared
from loreline.sources.worlds import World


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_chapter_meets_its_sentences_once(spark):
    chapters = spark.createDataFrame([(1, "Aa. Bb. Cc."), (2, "Dd. Ee.")], "id long, content string")
    rows = [(1, 0, 0, 3, "Aa."), (1, 1, 4, 7, "Xx."), (1, 2, 6, 11, ". Cc."), (2, 0, 0, 3, "Dd."), (2, 1, 4, 7, "Ee.")]
    found = spark.createDataFrame(rows, "id long, sentence int, start int, end int, text string")
    out = texts.broken_spans(found, chapters, "id", "content")
    assert out.columns == found.columns and sorted((r.id, r.sentence) for r in out.collect()) == [(1, 1), (1, 2)]
    assert "Window" not in plan(out)


def test_casts_are_lists_and_pairs_are_counted_once(spark):
    rows = [(1, 5), (1, 6), (1, 5), (1, 9), (2, 6), (2, 5), (3, 4), (None, 5), (None, 6), (4, None), (4, 5)]
    out = graph.co_stars(spark.createDataFrame(rows, "event_id long, entity_id long"))
    casts = {e: {p for x, p in rows if x == e and p is not None} for e, _ in rows if e is not None}
    want = Counter(pair for cast in casts.values() for pair in permutations(cast, 2))
    assert {(r.entity_id, r.other_id): r.n_events for r in out.collect()} == want
    assert "Join" not in plan(out)


def test_only_conjuncts_go_to_python(spark):
    rows = [(1, 0, "conj", 1), (1, 1, "conj", 2), (1, 2, "dobj", 5), (1, 3, None, 2), (1, 4, "conj", 5), (1, 5, "conj", 4), (2, 0, "ROOT", 0)]
    out = extraction.conjunct_heads(spark.createDataFrame(rows, "doc_id long, token_id int, rel string, head int"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 2), (1, 1, 2), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5), (2, 0, 0)]
    assert "= conj" in plan(out)


def test_manuscripts_meet_each_key_once(spark):
    books, chapters = spark.range(3).toDF("k"), spark.range(1000).select((F.col("id") % 2).alias("k"))
    out = views.with_chapters(books, chapters, "k")
    assert sorted(r.k for r in out.collect()) == [0, 1] and "Aggregate [k" in plan(out)


def test_pairs_of_names_are_not_gathered_again(spark, sf):
    out = plans.queries()["name_words_within"](spark, sf)
    top = plan(out).split("\n")
    assert "Aggregate" not in "".join(top[:2]) and out.count() == out.distinct().count()


def test_pairs_of_one_name_are_many_tasks(spark, tmp_path, monkeypatch):
    """A name that most share is expanded by all tasks, list by list; repeated and null keys count as they are."""
    monkeypatch.setattr(tables, "NAMES", 16)
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    rows = [(i % 290 if i else None, "red bolt" if i % 10 else f"bolt {i}", "RED" if i % 3 else "BIG") for i in range(300)] + [(7, None, "BIG")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    out = plans.queries()["name_words_within"](spark, str(tmp_path))
    words = [(k, name and set(name.split()), name and {*name.split(), kind.lower()}) for k, name, kind in rows]
    want = Counter((a, b) for a, x, _ in words for b, _, y in words if x and y and (x <= y or y <= x))
    assert Counter(map(tuple, out.collect())) == want
    assert most_in_a_task(out) < 0.6 * sum(want.values())


def test_relations_of_roles_are_found_once(spark, sf):
    """Only the clusters that new ones are numbered behind are read again."""
    assert plan(plans.queries()["role_relations"](spark, sf)).count("] parquet") <= 1


def test_parses_of_roles_are_dealt_out_once(spark, sf, monkeypatch):
    """By document, and what the walk decides once more; no table of tokens or relations is a checkpoint of plain rows."""
    plans_, keep = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(entities, "stored", lambda df: plans_.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entities.role_relations(World(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plans_[0].count("ENSURE_REQUIREMENTS") == 1 and "ExistingRDD" not in plans_[0]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_rounds_of_linking_write_what_is_open(spark, monkeypatch):
    """Clusters of one document wait for each other; those of the others are decided at once and not written in later rounds."""
    n, chain = 200, 8
    found = [(d, c, p, 20 * c + 10 * p, 20 * c + 10 * p + 5, "pronominal", "she") for d in range(1, n) for c in range(3) for p in range(2)]
    found += [(0, c, p, 10 * (c + p), 10 * (c + p) + 5, "pronominal", "she") for c in range(chain) for p in range(2)]
    table = spark.createDataFrame(found, "doc_id long, cluster int, place int, start int, end int, kind string, text string")
    mentions = spark.createDataFrame([], "doc_id long, mention_id string, start int, end int, type string")
    wrote = []
    keep = linking.settled
    monkeypatch.setattr(linking, "settled", lambda df: wrote.append((out := keep(df)).count()) or out)
    _, members = linking.link(table, mentions)
    assert members.select("doc_id").distinct().count() == n
    assert members.where("doc_id = 0").select("cluster_id").distinct().count() == chain // 2 and sum(wrote) < 4 * len(found)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_participations_are_dealt_out_by_their_number(spark, sf, monkeypatch):
    """Four times the tasks, and still by event: distinct rows and the joins with events move nothing again."""
    monkeypatch.setattr(shared, "ROWS_A_TASK", 300)
    w = World(spark, sf)
    n = w.raw("lineitem").count()
    assert most_in_a_task(w.participant()) < 2 * 300 * 2 < 2 * n / 4
    joined = w.participant().join(w.event().hint("merge"), "event_id")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(event_id") == 2


def test_character_stats_of_odd_rows(spark, tmp_path):
    """Repeated lines and events, events that are missing, no entity, no chapter."""
    day = "timestamp'2020-03-01' AS o_orderdate, 1L AS o_custkey, '1-URGENT' AS o_orderpriority"
    spark.sql(f"SELECT *, {day} FROM VALUES (1L, 'F'), (2L, 'P'), (3L, 'O'), (3L, 'O') AS t(o_orderkey, o_orderstatus)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 7L, 107L), (1L, 7L, 107L), (2L, 7L, 8L), (3L, 5L, 7L), (9L, 7L, 9L), (3L, NULL, 5L), (2L, 8L, NULL), (NULL, 7L, 7L) AS t(l_orderkey, l_suppkey, l_partkey)").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = aggregates.character_stats(World(spark, str(tmp_path)))
    assert {tuple(r) for r in out.collect()} == {(7, 3, "agent,patient", 1), (8, 1, "agent,patient", 0), (5, 1, "agent,patient", 1), (None, 2, "agent,patient", 1)}


def test_mentions_of_hybrids_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 100)
    rows = spark.range(2000).selectExpr("id DIV 8 AS doc", "id % 8 AS id", "'t' AS text", "'x' AS type", "'proper' AS kind", "id % 8 * 10 AS start", "id % 8 * 10 + 5 AS end", "id % 3 AS entity")
    cuts = rows.select("doc").distinct().selectExpr("doc", "IF(doc % 5 > 0, 35, NULL) AS end")
    out = hybrids.hybrid_mentions(rows, rows.drop("entity"), cuts.hint("merge"))
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert most_in_a_task(out) < 250
    assert out.count() == 200 * 8 and Counter((r.start, r.gold_id, r.id) for r in out.collect())[0, 0, "M1"] == 200


def test_lines_are_dealt_out_by_document_once(spark, sf):
    """Tables of a document are joined where its lines lie."""
    x = scores.lines(World(spark, sf))
    with shared.kept_apart(spark):
        both = x.join(x.hint("merge").select("doc", "slot", F.col("p").alias("other")), ["doc", "slot"])
        how = both._jdf.queryExecution().executedPlan().toString()
    assert how.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in how
