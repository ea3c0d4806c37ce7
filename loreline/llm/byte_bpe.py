"""Byte-level BPE by two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap of merges for the rest."""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreline.llm.common import joined_bytes, map_batches, mix, run_hashes
from loreline.llm.tokenizer_files import Memo, load_ranks, split_pattern, splitter, text_blocks

#: Pre-tokens that a worker remembers the ids of.
MEMO = 400_000


class PerfectHash:
    """Minimal perfect hash over byte strings (compress, hash, displace), looked up for many keys at once.

    n keys fall into n / 2 buckets by their hash; each bucket, largest first, gets the least seed that sends its keys to
    slots still free, and a bucket of one key names its slot outright. Slot i holds a key and its value; a lookup compares
    the bytes, so strings outside the key set are always told apart.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        h = self._hash(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys share a 64-bit hash")
        self.m = max(1, n // 2)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.m + 1))
        self.seeds = np.zeros(self.m, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        slot_of = np.zeros(n, dtype=np.int64)
        tries = np.arange(64, dtype=np.int64)[:, None]
        sizes = np.diff(first)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine, seed = order[first[b] : first[b + 1]], 0
            while True:
                slots = self._slots(h[mine][None, :], seed + tries)
                apart = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                if good.any():
                    break
                seed += len(tries)
            k = int(good.argmax())
            self.seeds[b] = seed + k
            free[slots[k]] = False
            slot_of[mine] = slots[k]
        single = np.flatnonzero(sizes == 1)
        slot_of[order[first[single]]] = left = np.flatnonzero(free)
        self.seeds[single] = -1 - left
        self.values = np.zeros(n, dtype=np.int64)
        self.values[slot_of] = values
        self.keys: list[bytes] = [b""] * n
        for k, s in zip(keys, slot_of.tolist(), strict=True):
            self.keys[s] = k

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        data, at = joined_bytes(pa.array(keys, type=pa.large_binary()).fill_null(b""))
        return run_hashes(data, at[:-1], at[1:])

    def _slots(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        slots = (mix(h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)
        return np.where(seed < 0, -1 - seed, slots)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """The value of each key; -1 for strings that are not keys."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = self._hash(keys)
        slots = self._slots(h, self.seeds[(h % np.uint64(self.m)).astype(np.int64)]).tolist()
        own, values = self.keys, self.values.tolist() if len(keys) > 1000 else self.values
        return [int(values[s]) if own[s] == k else -1 for k, s in zip(keys, slots, strict=True)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of neighbours of lowest rank joins first, the leftmost of equals, until none can.

    Parts are nodes of a doubly linked list over the bytes; the heap holds (rank, start, end) of pairs, and entries
    whose parts have changed are passed over.
    """
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # of the part that starts here, 0 once it is swallowed
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        j = before[i]
        if j >= 0:
            r = ranks.get(piece[j:stop])
            if r is not None:
                heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes and decodes with one rank file and split pattern. Special strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.find = splitter(pattern).findall
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        top = max(self.ranks.values()) + 1
        self.token_bytes = [b""] * top
        for t, i in self.ranks.items():
            self.token_bytes[i] = t
        self.decimal = [str(i) for i in range(top)]
        self.memo = Memo(MEMO)

    def learn(self, pieces: set[str]) -> None:
        self.memo.room(len(pieces))
        new = [p for p in pieces if p not in self.memo]
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, i in zip(new, coded, self.whole.lookup(coded), strict=True):
            self.memo[p] = (i,) if i >= 0 else tuple(merge_bytes(b, self.ranks))

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.find(t) for t in texts]
        self.learn(set().union(*pieces) if pieces else set())
        get = self.memo.__getitem__
        return [list(chain.from_iterable(map(get, found))) for found in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each document (doc_id, text; other columns are ignored); null texts give no ids."""
    pattern = pattern or split_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "ids": [x for b in text_blocks(texts) for x in encoder(path, pattern).encode(b)]}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of rows with doc_id and ids; null or empty ids give no bytes."""
    pattern = pattern or split_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "decoded": [encoder(path, pattern).decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_batches(coded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Encodes each text, decodes the ids again and returns digests of both: doc_id, n_tokens, ids_sha256 (of the decimal
    ids joined by a space) and decoded_sha256 (of the decoded bytes), hex.

    Same as encode and decode one after the other, in one pass over the rows. Null counts as empty; repeated rows give a row
    each; no documents give no rows.
    """
    pattern = pattern or split_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        e, n, digests, decoded = encoder(path, pattern), [], [], []
        for block in text_blocks([t or "" for t in batch.column(1).to_pylist()]):
            for ids in e.encode(block):
                n.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=4000)
