"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from loreline import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.9f}"
    return str(v)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in plans.queries() if n in plans.oracle_sql()])
def test_same_as_sql(name, spark, sf, duck):
    mine, theirs = plans.queries()[name](spark, sf).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in plans.oracle_sql()])
def test_gives_rows(name, spark, sf):
    """What they hold is tested on small tables of their own."""
    assert plans.queries()[name](spark, sf).count() > 0
