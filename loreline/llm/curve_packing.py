"""Packing along a space-filling curve: alike documents share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import joined_bytes, map_batches, parts_for, run_hashes, tidy, written
from loreline.llm.tokenizer_files import encode_texts, load_tokenizer

DIMS, BITS = 4, 10


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; no run crosses a text's end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def document_vectors(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """One unit vector a text: hashed words, each adding +1 or -1 to every dimension by a bit of its hash."""
    data, at = joined_bytes(texts)
    starts, ends = word_bounds(data, at)
    h = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    out = np.zeros((len(at) - 1, dims))
    for d in range(dims):
        sums = np.concatenate([[0], np.cumsum(((h >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1)])
        out[:, d] = sums[first[1:]] - sums[first[:-1]]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (integers under 2 ** bits), after Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    cells = np.floor((document_vectors(texts) + 1) / 2 * ((1 << BITS) - 1) + 0.5)
    return hilbert_keys(cells)


def cut(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Cuts a run of pieces (doc_id, start, ids, doc_tokens) into sequences of size ids, then the rest into powers of two."""
    left = sum(len(p[2]) for p in pieces)
    todo, now = list(reversed(pieces)), []
    while left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        now, fill = [], 0
        while fill < room:
            doc, start, ids, n = todo.pop()
            take = min(len(ids), room - fill)
            now.append((doc, start, ids[:take], n))
            if take < len(ids):
                todo.append((doc, start + take, ids[take:], n))
            fill += take
        left -= room
        yield now


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all documents (doc_id, text; other columns are ignored) into sequences of at most length ids.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, ids_crc32 (unsigned, of the ids
    as little-endian unsigned 32-bit integers), doc_tokens (with the end id), sequence_id, offset (in the sequence,
    gapless from 0). Documents are encoded once, into a table in the shared folder with their Hilbert key; the table is
    range-sorted by key and doc_id, so that not even equal keys of a third of all rows meet in one task, and each
    range is cut into full sequences as it streams by. What a range has left at its end is cut into sequences of powers
    of two, which need no padding; a sequence never crosses ranges. length must be a power of two. Null texts count as
    empty and give one piece, the end id; repeated rows are packed each; no documents give no rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    width = "<u2" if load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"

    def encode(batch: pa.RecordBatch) -> dict:
        ids, ends = encode_texts(batch.column(1), tokenizer, end_id)
        ids = ids.astype(width)
        return {"key": curve_keys(batch.column(1)), "doc_id": batch.column(0), "ids": [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]}

    coded = written(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), encode, "key long, doc_id long, ids binary"), "coded")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(sequences: Iterator[list[tuple]], first: int) -> tuple[pa.RecordBatch, int]:
        out, k = [], first
        for pieces in sequences:
            offset = 0
            for doc, start, ids, n in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, k, offset))
                offset += len(ids)
            k += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names), k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(data.as_buffer(), dtype=width)
                held.append((doc, 0, ids, len(ids)))
                size += len(ids)
            full, rest = [], []
            for seq in cut(held, length):
                (full if sum(len(p[2]) for p in seq) == length else rest).append(seq)
            held = [p for seq in rest for p in seq]
            size = sum(len(p[2]) for p in held)
            out, k = rows(iter(full), k)
            yield out
        out, k = rows(cut(held, length), k)
        yield out

    dealt = coded.repartitionByRange(parts_for(coded, "ids"), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))
