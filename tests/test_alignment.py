"""Alignment of spans: many documents in one stream, the same as a walk over each."""

import random

import pytest

from loreline import plans
from loreline.operators import spans
from loreline.sources.worlds import World


def greedy(pred, gold):
    out = []
    for doc in sorted({d for d, *_ in pred}):
        rows = [(min(pe, ge) - max(ps, gs), gs, ps, p, g) for d, p, ps, pe in pred for e, g, gs, ge in gold if d == e == doc and ps < ge and gs < pe]
        used_p, used_g = set(), set()
        for over, _, _, p, g in sorted(rows, key=lambda r: (-r[0], *r[1:])):
            if p not in used_p and g not in used_g:
                used_p.add(p)
                used_g.add(g)
                out.append((doc, p, g, over))
    return out


def test_documents_pass_by_in_batches(spark):
    """No document is a call of its own, and one that is cut by a batch goes on in the next."""
    rnd = random.Random(5)
    made = lambda n: [(d, i, s := rnd.randrange(60), s + rnd.randrange(1, 25)) for d in range(40) for i in range(rnd.randrange(n))]
    pred, gold = made(9), made(7)
    table = lambda rows: spark.createDataFrame(rows, "doc long, id long, start int, end int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        found = spans.align(table(pred), table(gold), ["doc"])
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(greedy(pred, gold))
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["mentions_by_source", "entity_scores", "document_scores"])
def test_lines_are_grouped_once(name, spark, sf, monkeypatch):
    """Every table of the documents is made of the lines; what is left lazy would read and group them again."""
    read = World.raw
    asked = []
    monkeypatch.setattr(World, "raw", lambda w, table: asked.append(table) or read(w, table))
    plan = plans.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert asked == ["lineitem"] and "l_orderkey" not in plan
