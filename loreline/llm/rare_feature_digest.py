"""Document fingerprints: improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import joined_bytes, mix, parts_for, pieces_of, powers, text_of, tidy

#: Bytes of a feature; positions that compete; least wins of a feature; features of a filter; bits of a filter; bits set by a feature.
WINDOW, SPAN, LEAST_WINS, PER_FILTER, FILTER_BITS, PROBES = 64, 64, 16, 160, 2048, 5

#: Windows of less entropy (thousandths) are runs and rules that say nothing of a text.
WEAK = 100

_SCALE = 1 << 20
_C_LOG_C = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], dtype=np.int64)

#: Bytes handled at a time; a window needs only its own bytes, so longer texts are taken in overlapping parts.
BLOCK = 1 << 19


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, in thousandths of the largest (6 bits), of each window of 64 bytes that starts in data.

    The sum of c log2 c over the byte counts of a window is kept by what each byte adds on entering and takes on
    leaving; both follow from how often it occurs in the 63 bytes before and after it. All sums are integers, so equal
    windows have equal entropies wherever they stand.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    earlier, later = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        earlier[d:] += same
        later[:-d] += same
    gain = np.diff(_C_LOG_C)
    change = gain[earlier]
    change[WINDOW:] -= gain[later[:-WINDOW]]
    sums = np.cumsum(change)[WINDOW - 1 :]
    return (6 * WINDOW * _SCALE - sums) * 1000 // (6 * WINDOW * _SCALE)


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy; one row an entropy comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1001, dtype=np.int64)
        for batch in batches:
            for part in pieces_of(batch, 0, BLOCK):
                data, at = joined_bytes(part.column(0))
                for low in range(0, max(len(data) - WINDOW + 1, 0), 4 * BLOCK):
                    found = entropies(data[low : low + 4 * BLOCK + WINDOW - 1])
                    inside = np.arange(low, low + len(found)) + WINDOW <= at[np.searchsorted(at, np.arange(low, low + len(found)), side="right")]
                    total += np.bincount(found[inside], minlength=1001)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1001)), pa.array(total)], names=["entropy", "n"])

    found = docs.select("text").mapInArrow(tidy(run), "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1001, dtype=np.int64)
    for r in found:
        out[r.entropy] = r.n
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, rarest first, by how many windows of the corpus have it; of equals the lesser first. Weak
    entropies come last, the least at the very end."""
    order = np.lexsort((np.arange(1001), counts))
    rank = np.empty(1001, dtype=np.int64)
    rank[order] = np.arange(1001)
    rank[:WEAK] = 1001 + np.arange(WEAK, 0, -1)
    return rank


def contest(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every 64 neighbouring windows of a text the rarest wins, the leftmost of equals: wins and key (rank, then place)
    of each window of texts joined in data (offsets at). Windows that cross a text's end have the largest keys."""
    m = len(data) - WINDOW + 1
    rank = ranks[entropies(data)]
    owner_end = np.repeat(at[1:] - WINDOW, np.diff(at))[:m]  # last window start of each text
    rank[np.arange(m) > owner_end] = 1 << 20
    key = (rank << 32) | np.arange(m)
    best = key.copy()
    step = 1
    while step < SPAN:
        best[:-step] = np.minimum(best[:-step], best[step:])
        step *= 2
    valid = np.arange(m) + SPAN - 1 <= owner_end
    return np.bincount(best[valid] & 0xFFFFFFFF, minlength=m), key


def window_hashes(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    back = powers(len(data) + 1, pow(int(powers(2)[1]), -1, 1 << 64))
    return mix((sums[where + WINDOW] - sums[where]) * back[where])


def features_of(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected features of texts joined in data (offsets at), in order.

    Windows that win at least 16 times are selected. A text in which none does selects the window with most wins, or its
    rarest where nothing could win; the leftmost of equals.
    """
    if len(data) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    wins, key = contest(data, at, ranks)
    last = at[1:] - WINDOW
    chosen = wins >= LEAST_WINS
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(wins)]
    has = np.zeros(len(at) - 1, dtype=bool)
    has[owner[chosen]] = True
    for t in np.flatnonzero(~has & (last >= at[:-1])).tolist():
        w = wins[at[t] : last[t] + 1]
        chosen[at[t] + int(w.argmax() if w.any() else key[at[t] : last[t] + 1].argmin())] = True
    where = np.flatnonzero(chosen)
    return where, window_hashes(data, where)


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (rows of 0 and 1) of a text's features in order, a new one after every 160 features."""
    k = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((k, FILTER_BITS), dtype=np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for p in range(PROBES):
        bits[row, ((hashes >> np.uint64(11 * p)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return bits


def as_string(bits: np.ndarray) -> str:
    """The number of filters, a colon, then their bits in base64; an empty text has none: "0:"."""
    return f"{len(bits)}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}"


def from_string(digest: str) -> np.ndarray:
    k, _, data = digest.partition(":")
    return np.unpackbits(np.frombuffer(base64.b64decode(data), dtype=np.uint8)).reshape(int(k), FILTER_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the digest with fewer filters (of equals, fewer bits) meets its best match in the other.

    The bits two filters share count from what chance would give (product of their bits over the filter size) to the
    most possible (bits of the sparser one). Two empty digests are alike, an empty and another are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), int(a.sum())) > (len(b), int(b.sum())):
        a, b = b, a
    nb, whole, total = b.sum(axis=1, dtype=np.float64)[None, :], b.astype(np.float32).T, 0.0
    for i in range(0, len(a), 256):
        part = a[i : i + 256]
        na = part.sum(axis=1, dtype=np.float64)[:, None]
        chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
        score = (part.astype(np.float32) @ whole - chance) / np.maximum(most - chance, 1e-9)
        total += float(np.clip(score, 0, 1).max(axis=1).sum())
    return total / len(a)


def long_features(text: bytes, ranks: np.ndarray) -> np.ndarray:
    """The same for one text taken in parts, each with the bytes that decide on its features on both sides."""
    found, most = [], (0, None)
    for a in range(0, len(text), BLOCK):
        low, high = max(0, a - SPAN), min(len(text), a + BLOCK + WINDOW + SPAN)
        if high - low < WINDOW:
            continue
        data = np.frombuffer(text, dtype=np.uint8, count=high - low, offset=low)
        wins, _ = contest(data, np.array([0, len(data)]), ranks)
        mine = np.arange(low, low + len(wins))
        mine = (mine >= a) & (mine < a + BLOCK)
        found.append(window_hashes(data, np.flatnonzero(mine & (wins >= LEAST_WINS))))
        top = int(np.where(mine, wins, -1).argmax())
        if wins[top] > most[0]:
            most = int(wins[top]), low + top
    hashes = np.concatenate(found)
    if len(hashes):
        return hashes
    return window_hashes(np.frombuffer(text, dtype=np.uint8, count=WINDOW, offset=most[1]), np.zeros(1, dtype=np.int64))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text. Texts under 64 bytes are padded with zero bytes to one window; empty ones have none."""
    out: list[np.ndarray] = [np.zeros((0, FILTER_BITS), dtype=np.uint8)] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            padded = [texts[i].ljust(WINDOW, b"\0") for i in group]
            at = np.concatenate([[0], np.cumsum([len(x) for x in padded])])
            where, hashes = features_of(np.frombuffer(b"".join(padded), dtype=np.uint8), at, ranks)
            cuts = np.searchsorted(where, at)
            for i, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                out[i] = filters_of(hashes[a:b])
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) > 2 * BLOCK:
            out[i] = filters_of(long_features(t, ranks))
        elif t:
            group.append(i)
            size += max(len(t), WINDOW)
            if size >= BLOCK:
                flush()
    flush()
    return out


def _neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, doc_id, text, head), each part sorted by doc_id and text; the first row of every part stands also,
    as head, at the end of the part before. One part's successor is known without a task that sees all rows."""
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    ids = docs.select("doc_id")
    marks = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    cut = Bucketizer(splits=[-float("inf"), *marks, float("inf")], inputCol="_at", outputCol="_part") if marks else None

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
        return (cut.transform(df) if cut else df.withColumn("_part", F.lit(0.0))).withColumn("part", F.col("_part").cast("long")).drop("_at", "_part")

    rows = dealt(docs)
    firsts = dealt(ids).groupBy("part").agg(F.when(F.count_if(F.col("doc_id").isNull()) == 0, F.min("doc_id")).alias("first"))
    found = sorted(((r.part, r.first) for r in firsts.collect()), key=lambda x: x[0])
    goes = [(p, first, found[i - 1][0]) for i, (p, first) in enumerate(found)]
    heads = docs.sparkSession.createDataFrame(goes, "part long, first long, goes long")
    lead = (
        rows.join(F.broadcast(heads), "part").where(F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("goes").agg(F.min(F.struct("doc_id", "text")).alias("d")).select(F.col("goes").alias("part"), "d.doc_id", "d.text", F.lit(True).alias("head"))
    )
    return rows.withColumn("head", F.lit(False)).unionByName(lead)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text; other columns are ignored), of its edited text, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by doc_id; the first follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty; rows that repeat a doc_id follow one another by
    text; null doc_ids come first; a single document follows itself; no documents give no rows. Entropies of all windows
    are counted first; how rare a window's entropy is decides which features are selected. Texts then cross one shuffle
    in ranges of doc_id, four a partition of 64 MB, and are read in order, two at a time; one row a range comes to the driver.
    """
    dealt_to = parts_for(docs, "text")
    ranks = rarity(entropy_counts(docs))
    rows = _neighbours(docs, 4 * dealt_to)

    def one(current: tuple[int, str, bytes, np.ndarray], following: tuple[int, str, bytes, np.ndarray]) -> tuple:
        doc, text, _, own = current
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[1][:half]).encode("utf-8", "surrogatepass")
        return doc, len(text), edited, own, following[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = piece.column(2).to_pylist()
                coded = [t.encode("utf-8", "surrogatepass") for t in texts]
                todo = []
                for p, doc, head, text, raw, own in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(3).to_pylist(), texts, coded, digests(coded, ranks), strict=True):
                    now = (doc, text, raw, own)
                    if last is not None and part == p:
                        todo.append(one(last, now))
                    last, part = (None if head else now), p
                if not todo:
                    continue
                edited = digests([x[2] for x in todo], ranks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in todo], pa.int64()), pa.array([x[1] for x in todo], pa.int64()),
                        pa.array([hashlib.sha256(x[2]).hexdigest() for x in todo]), pa.array([as_string(x[3]) for x in todo]), pa.array([as_string(e) for e in edited]),
                        pa.array([likeness(x[3], e) for x, e in zip(todo, edited, strict=True)], pa.float64()), pa.array([likeness(x[3], x[4]) for x in todo], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    in_order = rows.repartition(dealt_to, "part").sortWithinPartitions("part", "head", "doc_id", "text").select("part", "doc_id", "text", "head")
    return in_order.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
