"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm.common import map_batches, pieces_of
from loreline.llm.tokenizer_files import encode_texts

SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"

#: Small stripes let several tasks read one file; an index entry every 1000 rows lets a reader pass the others over.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, options: dict[str, str] | None = None) -> None:
    """Encodes every document (doc_id, text; other columns are ignored) and writes ORC files in ascending doc_id order.

    The files hold doc_id, file_start (ids before the document in its file), n_tokens and ids. Documents are dealt by
    ranges of doc_id, so files follow one another without overlap; rows that repeat a doc_id stand next to each other by
    text, null doc_ids come first. Null texts count as empty and hold the end id alone, or nothing without one. No
    documents: no rows. The text crosses one shuffle and ids are never sorted.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for part in pieces_of(batch, 1, 8 << 20):
                flat, ends = encode_texts(part.column(1), tokenizer, end_id)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), ids], schema=arrow)
                before += int(ends[-1])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.options(**(options or ORC_OPTIONS)).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids. A scan is split by stripes, not by files.

    The ids before a file are summed from the doc_id and n_tokens columns alone; one row a file comes to the driver.
    """
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.input_file_name())
    files = rows.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("n")).collect()
    base, starts = 0, []
    for f in sorted(files, key=lambda f: (f.first is not None, f.first or 0)):
        starts.append((f.file, base))
        base += f.n
    bases = spark.createDataFrame(starts, "file string, base long")
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; row indexes and Bloom filters spare the reader stripes without them."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(3)
        ends = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
        return {"doc_id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2), "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]}

    return map_batches(tokens.select("doc_id", "start", "n_tokens", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
