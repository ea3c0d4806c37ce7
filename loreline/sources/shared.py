"""Where lineage ends, in the folder that the driver and all executors share, and how tables are dealt out to tasks."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> None:
    """From here on the session's unions put their inputs one behind the other. Spark 4.1 zips inputs that are partitioned alike,
    and fails ("unequal numbers of partitions") where adaptive execution has coalesced one of them and not the other, as it
    may with any union of windowed tables."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Rows that one task takes of a table that is dealt out by its size.
ROWS_A_TASK = 1 << 18


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt out by keys into as many partitions as its rows call for (rows: how many, if known), at least as many as shuffles
    have, so that what a task sorts or gathers does not grow with the table. Joins and groups by more than the keys keep them."""
    n = df.count() if rows is None else rows
    return df.repartition(max(-(-n // ROWS_A_TASK), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints. Where none is set, a local folder serves a local master; on a cluster that is an error, since
    each executor would write to its own disk."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        known = context.getConf().get("spark.checkpoint.dir")
        if known:
            return known
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loreline-"))
        at = context._jsc.sc().getCheckpointDir()
    return at.get()


def settled(df: DataFrame) -> DataFrame:
    """df written as a checkpoint under spark.checkpoint.dir."""
    _shared_dir(df.sparkSession)
    return df.checkpoint()


_stored: list[str] = []


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _stored if spark is not None else ():
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit
            return


@contextlib.contextmanager
def kept_apart(spark: SparkSession) -> Iterator[None]:
    """What runs in here joins tables that are dealt out alike by some of the keys where they lie; Spark by itself deals both out
    again by all keys. Only for tables that dealt has cut by their size: the rows of few keys would be few tasks."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """df written as compressed columns (ORC) in the folder of checkpoints and read back: a fifth and less of a checkpoint's bytes, but rows
    do not stay dealt out."""
    path = f"{_shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.orc(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).orc(path)
