"""Each stage of the pipeline against its own input, and the queries of the operators against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from loreline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_repeats, jaccard_links


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(f"{at}/{k}")
        after = spark.read.parquet(f"{at}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_and_rows(steps, spark, sf):
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, *_ in steps] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    assert all(after.columns == names for *_, after in steps[:-1])


def test_quality_only_drops(steps):
    _, before, after = steps[0]
    assert set(texts(after)) <= set(texts(before)) and 0 < after.count() <= before.count()


def test_exact_stage(steps):
    _, before, after = steps[1]
    keep = {}
    for i, t in texts(before):
        keep[t] = max(i, keep.get(t, i))
    assert texts(after) == sorted((i, t) for t, i in keep.items())


def test_near_stage(steps):
    _, before, after = steps[2]
    rows = texts(before)
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in jaccard_links(rows):
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert {i for i, _ in texts(after)} == {top(i) for i, _ in rows}


def test_suffix_stage(steps):
    _, before, after = steps[3]
    want, kept = brute_repeats(texts(before), 100), dict(texts(after))
    assert set(want) == set(kept)
    for i, (n, gone, *_) in want.items():
        assert n - gone - 6 * want[i][2] <= len(kept[i].encode()) <= n - gone


def test_packing_stage(steps):
    _, before, after = steps[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _ in texts(before)}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    mine, theirs = QUERIES[name](spark, sf).toPandas(), c.execute(ORACLE_SQL[name]).df()
    cols = sorted(mine.columns)
    plain = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    assert cols == sorted(theirs.columns) and plain(mine) == plain(theirs)
