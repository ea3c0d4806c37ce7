"""Joins on intervals, and one-to-one alignment. Spans are half-open; columns start and end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the bins that turn an interval join into an equality join.
BIN = 1024


def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int = BIN) -> DataFrame:
    """Pairs of left and right spans of one key that overlap: key, l (struct), r (struct), overlap.

    A span is filed under each bin that it touches and a pair counts in the first bin that both touch, so a long document is no
    single task and pairs are found once. Empty spans overlap nothing.
    """

    def filed(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("start < end").select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
        return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{name}.start") / width), F.floor((F.col(f"{name}.end") - 1) / width))))

    both = filed(left, "l").join(filed(right, "r"), [*key, "_bin"])
    overlap = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    first = F.floor(F.greatest("l.start", "r.start") / width)
    return both.where((overlap > 0) & (F.col("_bin") == first)).select(*key, "l", "r", overlap.alias("overlap"))


def containing(inner: DataFrame, outer: DataFrame, key: list[str], inner_id: str) -> DataFrame:
    """For each inner span the smallest outer span that holds it, of equals the first: key, l (inner), r (outer)."""
    pairs = overlapping(inner, outer, key).where("r.start <= l.start AND l.end <= r.end")
    best = F.min_by("r", F.struct(F.col("r.end") - F.col("r.start"), F.col("r.start")))
    return pairs.groupBy(*key, F.col(f"l.{inner_id}").alias(inner_id)).agg(F.first("l").alias("l"), best.alias("r"))


def at_points(points: DataFrame, spans: DataFrame, key: list[str], at: str) -> DataFrame:
    """Points (key, at) with the span that holds each."""
    as_span = points.withColumns({"start": F.col(at), "end": F.col(at) + 1})
    return overlapping(as_span, spans, key).select(*key, "l", "r")


def align(pred: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """One-to-one pairs (key, pred_id, gold_id, overlap) of the spans (key, id, start, end) of a document: the largest
    overlap first, ties by gold start, predicted start and ids. Only overlapping pairs are walked. They are sorted by the
    shuffle and pass by in batches, many documents one behind the other; kept are the ids used in the document at hand."""
    pairs = overlapping(pred, gold, key).select(*key, F.col("l.id").alias("pred_id"), F.col("r.id").alias("gold_id"), "overlap", F.col("l.start").alias("p"), F.col("r.start").alias("g"))
    order = [*key, F.desc("overlap"), "g", "p", F.asc_nulls_last("pred_id"), F.asc_nulls_last("gold_id")]
    n = len(key)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used_p, used_g = None, set(), set()
        for batch in batches:
            keep = []
            for doc, p, g in zip(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if doc != at:
                    at, used_p, used_g = doc, set(), set()
                free = p not in used_p and g not in used_g
                if free:
                    used_p.add(p)
                    used_g.add(g)
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "pred_id", "gold_id", "overlap"])
    ordered = pairs.repartition(*key).sortWithinPartitions(*order).select(*key, "pred_id", "gold_id", "overlap")
    return ordered.mapInArrow(walk, schema)
