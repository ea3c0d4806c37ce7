"""Queries over whole tables: rows far beyond the small keys count as the others do."""

import pytest
from pyspark.sql import functions as F

from loreline import plans

FAR = 1_000_000


@pytest.fixture(scope="module")
def far(spark, sf, tmp_path_factory):
    """The smallest tables with their keys moved up; customers and parts keep their last digits."""
    at = str(tmp_path_factory.mktemp("far"))
    moved = {"part": ["p_partkey"], "customer": ["c_custkey"], "conversations": ["conv_id"]}
    for name, keys in moved.items():
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.withColumns({k: (F.col(k) + FAR).cast(df.schema[k].dataType) for k in keys}).write.parquet(f"{at}/{name}.parquet")
    return at


def run(name, spark, at):
    return plans.queries()[name](spark, at)


def test_resolution_of_all_mentions(spark, sf, far):
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    out = run("entity_resolution", spark, far)
    assert out.count() == n and out.where(F.col("mention_id") >= FAR).count() == n


def test_aliases_of_all_entities(spark, sf, far):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    merged = {i + FAR - 1 if (i + FAR) % 4 == 1 else i + FAR for i in ids}
    assert {r.entity_id for r in run("merge_aliases", spark, far).collect()} == merged


def test_participants_of_all_turns(spark, sf, far):
    want = {r.role: r.n for r in run("token_participants", spark, far).collect()}
    assert want and all(want.values())
