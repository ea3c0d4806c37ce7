"""Registered queries: name to (query over a World, the same in SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreline.plans import aggregates, answers, editions, entities, evaluation, hybrids, narrative, questions, scores, tables, texts, views, writes
from loreline.sources.worlds import World

ALL: dict[str, tuple[Callable[[World], DataFrame], str | None]] = {}
for _module in (narrative, tables, aggregates, evaluation, texts, writes, views, hybrids, scores, editions, answers, entities, questions):
    ALL |= _module.QUERIES


def _run(fn: Callable[[World], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(World(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(fn) for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
