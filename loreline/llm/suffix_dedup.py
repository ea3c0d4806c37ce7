"""Suffix-array dedup of repeated passages over all documents."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import joined_bytes, keyed, mix, parts_for, pieces_of, powers, text_of, tidy, unpacked, written
from loreline.llm.induced_sorting import induced_order

#: Bytes of a match, and of the grams that decide which stretches may hold one.
MATCH, GRAM = 100, 32

#: Bytes sorted at a time, and different stretches of one group that are sorted together; larger groups are split.
SHARD, SPLIT = 3 << 19, 2048

#: Distances between match and gram that the classes of a split group span, from split to split. The last holds one match each.
WIDTHS = (9, 1)

#: One document in so many tells which grams are popular, and the share of its stretches (one in so many) that makes one so.
SAMPLE, POPULAR = 16, 4096

_BACK = pow(int(powers(2)[1]), -1, 1 << 64)


def gram_size(match: int) -> int:
    return min(GRAM, match)


def stretches(data: np.ndarray, at: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the places where a match may start into stretches that share the least gram (by hash, leftmost) of their match.

    Returns the first place, the number of places, where the gram stands after the first place, and the gram's hash.
    Equal matches have equal grams at the same distance, whatever the hash, so equal bytes can only be found between
    stretches of one gram hash; a stretch never holds equal matches itself.
    """
    gram = gram_size(match)
    window, m = match - gram + 1, len(data) - match + 1
    if m < 1:
        return (np.zeros(0, np.int64),) * 4
    n = len(data)
    sums, back = np.zeros(n + 1, dtype=np.uint64), powers(n + 1, _BACK)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    best = ((h >> np.uint64(33)) << np.uint64(32)).astype(np.int64) | np.arange(len(h))
    step = 1
    while 2 * step <= window:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    least = np.minimum(best[:m], best[window - step : window - step + m]) & 0xFFFFFFFF
    inside = np.arange(m) + match <= np.repeat(at[1:], np.diff(at))[:m]
    fresh = np.concatenate([[True], least[1:] != least[:-1]]) | ~inside
    fresh[1:] |= ~inside[:-1]
    edges = np.flatnonzero(fresh)
    sizes = np.diff(np.append(edges, m))
    good = inside[edges]
    first, sizes = edges[good], sizes[good]
    return first, sizes, least[first] - first, h[least[first]].view(np.int64)


def contents_of(data: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each data[first:end], as two integers: a cryptographic digest, so none are known that clash."""
    whole, digest = memoryview(data.tobytes()), hashlib.blake2b
    out = b"".join([digest(whole[a:b]).digest() for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
    found = np.frombuffer(out, dtype="<i8").reshape(-1, 8)
    return found[:, 0].copy(), found[:, 1].copy()


def classes_of(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, off: np.ndarray, width: int, match: int) -> tuple[np.ndarray, ...]:
    """Splits stretches by the distance between match and gram, in classes of so many distances.

    All matches of a class hold the gram and the bytes next to it that the least and the largest distance of the class
    leave on either side. A digest of these bytes and the class is the new group: equal matches have it in common.
    Returns owner (number of the stretch), first, sizes, off and group of each part.
    """
    gram, whole, digest = gram_size(match), memoryview(data.tobytes()), hashlib.blake2b
    most, out, groups = match - gram, [], []
    for k, (f, n, o) in enumerate(zip(first.tolist(), sizes.tolist(), off.tolist(), strict=True)):
        at, low = f + o, o - n + 1
        for c in range(low // width, o // width + 1):
            least, largest = max(c * width, 0), min(c * width + width - 1, most)
            begin, end = at - min(largest, o), at - max(least, low) + 1
            out.append((k, begin, end - begin, at - begin))
            groups.append(digest(whole[at - least : at + gram + most - largest], salt=c.to_bytes(4, "little")).digest()[:8])
    cols = np.array(out, dtype=np.int64).reshape(-1, 4)
    return *cols.T, np.frombuffer(b"".join(groups), dtype="<i8")


def place_of(first: np.ndarray, sizes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A stretch as an integer: its first byte in its text, its places (under 256) and where its gram stands (under 256)."""
    return (first << 16) | (sizes << 8) | off


#: Stretches a task holds before it sends them on.
HELD = 4_000_000

_ROW = "group long, content long, content2 long, key long, place long, copy boolean"
_NAMES = ["group", "content", "content2", "key", "place", "copy"]


def _sent(rows: list[np.ndarray]) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of _NAMES for rows (group, content, content2, key, place) in order, and that order.

    Of stretches that a task sees twice only the earliest can be the earliest of all; the others are copies already, and
    need no group and content. However popular a stretch is, a task sends one of it to its group.
    """
    order = np.lexsort((rows[4], rows[3], rows[2], rows[1]))
    rows = [x[order] for x in rows]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]) | (rows[0][1:] != rows[0][:-1])
    for k in range(3):
        rows[k][~first] = 0
    return [*[pa.array(x) for x in rows], pa.array(~first)], order


def popular_grams(docs: DataFrame, match: int) -> list[int]:
    """Up to POPULAR grams with the most different stretches in a sample. They are split from the start; what the sample
    misses is split later, so it decides about the way and never about results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 0, 1 << 20):
                data, at = joined_bytes(part.column(0))
                first, sizes, _, gram = stretches(data, at, match)
                rows = np.unique(np.stack([gram, *contents_of(data, first, first + sizes + match - 1)]), axis=1) if len(first) else np.zeros((1, 0), np.int64)
                value, count = np.unique(rows[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count)], names=["gram", "n"])

    counts = docs.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(tidy(run), "gram long, n long")
    most = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(f"n > {SPLIT // SAMPLE}").orderBy(F.desc("n"), "gram").limit(POPULAR)
    return [r.gram for r in most.collect()]


def seeds(docs: DataFrame, match: int) -> DataFrame:
    """Rows of _NAMES for every stretch of docs (key, text), those of popular grams split."""
    popular = np.array(popular_grams(docs, match), dtype=np.int64)

    def found_in(part: pa.RecordBatch) -> list[np.ndarray]:
        data, at = joined_bytes(part.column(1))
        first, sizes, off, group = stretches(data, at, match)
        split = np.isin(group, popular) if len(popular) else np.zeros(len(group), dtype=bool)
        if split.any():
            _, *parts = classes_of(data, first[split], sizes[split], off[split], WIDTHS[0], match)
            first, sizes, off, group = (np.concatenate([x[~split], y]) for x, y in zip((first, sizes, off, group), parts, strict=True))
        own = np.searchsorted(at, first, side="right") - 1
        return [group, *contents_of(data, first, first + sizes + match - 1), part.column(0).to_numpy()[own], place_of(first - at[own], sizes, off)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def send() -> pa.RecordBatch:
            cols, _ = _sent([np.concatenate(c) for c in zip(*held, strict=True)])
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=_NAMES)

        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 20):
                held.append(found_in(part))
                if sum(len(h[0]) for h in held) > HELD:
                    yield send()
        if held:
            yield send()

    return docs.select("key", "text").mapInArrow(tidy(run), _ROW)


def _judge(found: DataFrame, extra: list[str]) -> DataFrame:
    """group, key, place, copy and extra of the stretches that may hold repeats: copies, and the earliest of each content
    of a group that has several. Rows come sorted and pass one by one; only the first row of a group waits for another."""
    names = ["group", "key", "place", "copy", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None  # last row seen (group, content, content2); the first row of its group while it has one content
        for batch in batches:
            n = batch.num_rows
            rows = pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 3, 4, 5, *range(6, 6 + len(extra)))], names=names)
            copy = batch.column(5).to_numpy(zero_copy_only=False)
            settled = int(copy.sum())  # they stand first
            if settled:
                yield rows.slice(0, settled)
            if settled == n:
                continue
            rows = rows.slice(settled)
            group, *content = (batch.column(i).to_numpy()[settled:] for i in range(3))
            fresh, first = np.ones(len(group), dtype=bool), np.ones(len(group), dtype=bool)
            fresh[1:] = group[1:] != group[:-1]
            fresh[0] = last is None or group[0] != last[0]
            first[1:] = fresh[1:] | (content[0][1:] != content[0][:-1]) | (content[1][1:] != content[1][:-1])
            first[0] = fresh[0] or (content[0][0], content[1][0]) != last[1:]
            of = np.cumsum(fresh)
            contents = np.bincount(of[first], minlength=of[-1] + 1)
            if not fresh[0]:
                if waiting is not None and contents[0]:
                    yield waiting
                    waiting = None
                contents[0] = 1 if waiting is not None else 2
            keep = ~first | (contents[of] > 1)
            if of[-1] > 0 or fresh[0]:
                waiting = rows.slice(int(np.flatnonzero(fresh)[-1]), 1) if contents[of[-1]] == 1 else None
            cols = [c for c in rows.columns]
            cols[3] = pa.array(~first)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))
            last = (group[-1], content[0][-1], content[1][-1])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("copy").desc(), "group", "content", "content2", "key", "place"]
    route = F.when(F.col("copy"), F.xxhash64("key", "place")).otherwise(F.col("group"))  # copies go anywhere
    dealt = found.repartition(parts, route).sortWithinPartitions(*order).select(*_NAMES, *extra)
    return dealt.mapInArrow(tidy(run), ", ".join(["group long, key long, place long, copy boolean", *[f"{x} binary" for x in extra]]))


def repeats_in_shard(segments: list[tuple[int, int, bytes]], match: int, limit: int = 1 << 28, base: int = 1 << 22) -> list[tuple[int, int]]:
    """(key, place) of runs of matches that also start earlier, among segments (key, place, bytes).

    The segments stand in the order of key and place, each followed by a separator, so that earlier in the shard
    is earlier in the corpus. Suffixes that share match bytes are neighbours in suffix order; all but the first are repeats.
    """
    segments = sorted(segments, key=lambda s: s[:2])
    lengths = np.array([len(s[2]) + 1 for s in segments])
    data = np.frombuffer(b"\0".join(s[2] for s in segments) + b"\0", dtype=np.uint8)
    text = data.astype(np.int16) + 1
    begin = np.cumsum(lengths) - lengths
    text[begin + lengths - 1] = 0
    order, common = induced_order(text, match, limit, base)
    starts = np.zeros(len(text), dtype=bool)
    places = np.array([s[1] >> 8 & 255 for s in segments])
    starts[np.repeat(begin, places) + np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)] = True
    group = np.cumsum(common < match)
    mine = starts[order]
    order, group = order[mine], group[mine]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    repeat = np.zeros(len(text), dtype=bool)
    repeat[order] = order != np.repeat(np.minimum.reduceat(order, cut), np.diff(np.append(cut, len(order))))
    found = np.flatnonzero(repeat)
    if not len(found):
        return []
    run = np.flatnonzero(np.concatenate([[True], np.diff(found) > 1]))
    first, n = found[run], np.diff(np.append(run, len(found)))
    own = np.searchsorted(begin, first, side="right") - 1
    return [(segments[s][0], ((segments[s][1] >> 16) + p) << 16 | k << 8) for s, p, k in zip(own.tolist(), (first - begin[own]).tolist(), n.tolist(), strict=True)]


def _segments(docs: DataFrame, wanted: DataFrame, match: int) -> DataFrame:
    """group, key, place and data (bytes) of the stretches in wanted (key, runs of group and place), cut from the texts."""
    names = ["group", "key", "place", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 20):
                out: list[tuple] = []
                for key, text, runs in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for r in runs:
                        first, n = r["place"] >> 16, r["place"] >> 8 & 255
                        out.append((r["group"], key, r["place"], raw[first : first + n + match - 1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    return docs.join(wanted, "key").select("key", "text", "runs").mapInArrow(tidy(run), "group long, key long, place long, data binary")


def parts_of(rows: list[tuple[int, int, bytes]], width: int, match: int) -> list[tuple]:
    """Rows of _NAMES and data for the classes of stretches (key, place, bytes); data is null for copies."""
    whole = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
    begin = np.cumsum([0, *[len(r[2]) for r in rows[:-1]]])
    place = np.array([r[1] for r in rows])
    owner, first, sizes, off, group = classes_of(whole, begin, place >> 8 & 255, place & 255, width, match)
    ends = first + sizes + match - 1
    moved = place_of((place >> 16)[owner] + first - begin[owner], sizes, off)
    cols, order = _sent([group, *contents_of(whole, first, ends), np.array([r[0] for r in rows])[owner], moved])
    data = [None if copied else whole[a:b].tobytes() for a, b, copied in zip(first[order].tolist(), ends[order].tolist(), cols[5].to_pylist(), strict=True)]
    return [*cols, pa.array(data, pa.binary())]


def _shards(segments: DataFrame, match: int, width: int) -> DataFrame:
    """Sorts segments of one group together, many groups to a shard. Rows: key and place of the repeats found (copy is
    true), and for groups of more than SPLIT segments the rows of parts_of instead."""
    names = [*_NAMES, "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, bytes]] = []  # segments of complete groups
        group: list[tuple[int, int, bytes]] = []  # segments of the last group
        size, last, large = 0, None, False

        def sort() -> pa.RecordBatch:
            found = repeats_in_shard(shard, match)
            shard.clear()
            nothing, n = pa.nulls(len(found), pa.int64()), len(found)
            key, place = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([nothing, nothing, nothing, key, place, pa.array([True] * n, pa.bool_()), pa.nulls(n, pa.binary())], names=names)

        def split() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(parts_of(group, width, match), names=names)
            group.clear()
            return out

        for batch in batches:
            for of, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if of != last:
                    if large and group:
                        yield split()
                    shard += group
                    group.clear()
                    large, last = False, of
                    if size > SHARD:
                        yield sort()
                        size = 0
                group.append(tuple(row))
                if len(group) >= SPLIT:
                    if not large:
                        size -= sum(len(r[2]) for r in group[:-1])
                    large = True
                    yield split()
                elif not large:
                    size += len(row[2])
        if large and group:
            yield split()
        shard += group
        if shard:
            yield sort()

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(n, "group").sortWithinPartitions("group").mapInArrow(tidy(run), f"{_ROW}, data binary")


def _cut(docs: DataFrame, repeats: DataFrame, match: int) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (text) of all docs (key, text)."""
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def one(text: str, places: list[int] | None) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        if not places:
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), text
        edges = np.zeros(len(raw) + 1, dtype=np.int64)
        first, n = np.array(places) >> 16, np.array(places) >> 8 & 255
        np.add.at(edges, first, 1)
        np.add.at(edges, first + n + match - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, 1 << 20):
                rows = [one(t, p) for t, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4], pa.string())], names=names)

    places = repeats.groupBy("key").agg(F.collect_list("place").alias("places"))
    return docs.join(places, "key", "left").select("key", "text", "places").mapInArrow(tidy(run), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def find_repeats(texts: DataFrame, by_key: DataFrame, match: int) -> DataFrame:
    """key and place of every run of places whose match also starts earlier, of texts (key, text).

    Stretches whose gram occurs once cannot repeat. Among the others, all copies of a stretch but the earliest repeat it
    whole; the earliest ones of a group that has several are sorted in shards. Only these carry bytes between tasks. A
    group of more than SPLIT different stretches is split by the bytes next to its gram and judged again, at last down
    to single matches, so no shard outgrows memory however many documents share a line between other neighbours.
    """
    found = written(_judge(seeds(texts, match), []), "stretches")
    out = [found.where("copy").select("key", "place")]
    wanted = found.where("not copy").groupBy("key").agg(F.collect_list(F.struct("group", "place")).alias("runs"))
    segments = _segments(by_key, wanted, match)
    for width in WIDTHS:
        done = written(_shards(segments, match, width), "sorted")
        out.append(done.where("group IS NULL").select("key", "place"))
        left = done.where("group IS NOT NULL")
        if left.isEmpty():
            break
        found = written(_judge(left, ["data"]), "stretches")
        out.append(found.where("copy").select("key", "place"))
        segments = found.where("not copy").select("group", "key", "place", "data")
    return functools.reduce(DataFrame.unionByName, out)


def _judged(rows: DataFrame, plain: bool, match: int) -> DataFrame:
    """A row of _cut for each key of rows, which keyed has made."""
    texts = rows.select("key", text_of().alias("text"))
    texts = texts if plain else texts.dropDuplicates(["key"])
    by_key = texts.repartition(parts_for(texts, "text"), "key")
    return _cut(by_key, find_repeats(texts, by_key, match), match)


def suffix_dedup(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """Judges every byte of docs (doc_id, text; other columns are ignored): it goes if a string of match bytes that covers
    it also starts earlier, in a document of smaller doc_id or further up in its own.

    Returns for each row doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)
    and kept (the remaining text; a character that lost some of its bytes is gone). Texts are UTF-8 bytes, null counts as
    empty, matches do not cross documents, overlaps count and strings are judged on the input. Rows that repeat a doc_id
    follow each other by a hash of their text; rows that repeat both are judged as one and share its result. Null
    doc_ids come first. Texts shorter than match (at most 200) are kept. No documents give no rows.
    """
    rows, plain = keyed(docs.select("doc_id", "text"))
    out = _judged(rows, plain, match)
    if plain:
        return out.withColumnRenamed("key", "doc_id")
    return rows.select("key", "doc_id").join(out, "key").drop("key")


def cut_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """docs with text as suffix_dedup keeps it and n_chars, where there is one, to match; other columns stand.

    Every row stays, also with a null or repeated doc_id, and those of which nothing is left, with an empty text.
    """
    rows, plain = keyed(docs)
    kept = _judged(rows, plain, match).select("key", "kept")
    out = rows.drop("text").join(kept, "key").withColumnRenamed("kept", "text")
    return unpacked(out, docs.columns, n_chars=F.char_length("text").cast("long"))
