"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


#: Rows that Spark hands to a worker at a time in the pipeline. Long texts make its own 10,000 many megabytes, on both sides.
BATCH = 1000


def bound_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have at most BATCH rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a local one is made for a local master;
    on a cluster that is an error, since each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loreline-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written.append(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark is not None else ():
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone at exit
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives memory that it has freed back to the system when it ends: workers live on and would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def pieces_of(batch: pa.RecordBatch, column: int, size: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and about so many bytes of a string column; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = min(max(int(np.searchsorted(ends, done + size, side="right")), at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at, done = stop, int(ends[min(stop, len(ends)) - 1])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 500) -> DataFrame:
    """Runs fn on Arrow batches of few rows, so that what it makes of them stays small; it returns the columns of schema."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def hot_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, parts: int = 512) -> DataFrame:
    """Left join with right (one row a key, weight: its rows on the left) that no hot key overloads.

    Keys with more than total / parts rows are fewer than parts, whatever the data, so they are broadcast; the others
    go by a shuffle in which no key holds more than that share. Rows that a hot key has matched get a key of their own
    in that shuffle. key must be a string column that never starts with a NUL.
    """
    least = max(total // parts, 1)
    cols = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) > least).select(F.col(key), F.struct(*cols).alias("_hot"))
    cold = right.where(F.col(weight) <= least).select(F.col(key).alias("_key"), F.struct(*cols).alias("_cold"))
    mixed = left.join(F.broadcast(hot), key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64(*left.columns).cast("string")))
    )
    out = mixed.join(cold, "_key", "left")
    return out.select(*left.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in cols])


def packed(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, and rest: a struct of all columns but text, so that no name of docs meets one made later."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))


def unpacked(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """rows of packed with the columns names as they were, but for those in new."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("rest").getField(c)).alias(c) for c in names])


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """packed docs with key: doc_id where it is unique and never null, else its rank by doc_id (nulls first) and text
    hash; null texts count as empty. Also whether the first holds."""
    rows = packed(docs)
    if rows.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return rows.withColumn("key", F.col("doc_id")), True
    rows = rows.withColumn("sha", F.sha2(text_of().cast("binary"), 256))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * k, pa.int64()), pa.array(range(n, n + k), pa.int64())], names=["id", "of", "part", "rank"])
            n += k

    ranked = rows.select(F.col("doc_id").alias("id"), F.col("sha").alias("of")).distinct().repartitionByRange("id", "of").sortWithinPartitions("id", "of")
    ranked = written(ranked.mapInArrow(number, "id long, of string, part long, rank long"), "ranks")
    before, bases = 0, []
    for part, n in sorted(ranked.groupBy("part").count().collect()):
        bases.append((part, before))
        before += n
    ranked = ranked.join(F.broadcast(docs.sparkSession.createDataFrame(bases, "part long, base long")), "part").select("id", "of", (F.col("base") + F.col("rank")).alias("key"))
    return rows.join(ranked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of"))).select("doc_id", "text", "rest", "key"), False


def parts_for(df: DataFrame, column: str, size: int = 64 << 20) -> int:
    """Partitions of about so many bytes of a string or binary column, at least as many as shuffles have."""
    found = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // size))


# ---- bytes of a batch, hashed with vector operations

_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)


def powers(n: int, base: int = _P) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    size, step = 1, base & _M64
    while size < n:
        take = min(size, n - size)
        out[size : size + take] = out[:take] * np.uint64(step)
        size, step = size + take, step * step & _M64
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and the offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    back = powers(n + 1, _P_INV)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
