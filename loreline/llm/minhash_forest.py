"""N-gram Jaccard join: an LSH forest of MinHash labels finds candidates, exact set comparison decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import hot_lookup, joined_bytes, keyed, map_batches, mix, run_hashes, text_of, tidy, unpacked, written
from loreline.llm.curve_packing import word_bounds

#: Prefix trees, and the levels of a label: one byte of a MinHash value each, so that a label is a 64-bit integer.
TREES, LEVELS = 24, 8

#: Documents and bytes of text compared at a time. Larger candidate groups are compared block by block.
BLOCK, BLOCK_BYTES = 512, 4 << 20

#: Deviations that an estimate of likeness may fall short before a pair counts as no candidate, and the rows of a prefix
#: beyond which its neighbours count as candidates without an estimate.
DEVIATIONS, POPULAR = 6.0, 20_000


def depth_for(threshold: float, recall: float, trees: int = TREES) -> int:
    """Longest prefix at which two texts of that likeness meet in some tree with the target probability."""
    for depth in range(LEVELS, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for that recall")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of words (split at ASCII white space) and the number of its text, for labels only.

    A text of fewer words is one run of all its words; one without words has none. Sorted by text, then hash.
    """
    data, at = joined_bytes(texts)
    starts, ends = word_bounds(data, at)
    h = run_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    runs = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(n)), runs)
    begin = np.repeat(first[:-1], runs) + np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)
    last = first[1:][own]
    total = np.zeros(len(own), dtype=np.uint64)
    for k in range(words):
        inside = begin + k < last
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, h[np.minimum(begin + k, max(len(h) - 1, 0))], np.uint64(k + 1)) if len(h) else total
    sets = mix(total)
    order = np.lexsort((sets, own))
    sets, own = sets[order], own[order]
    fresh = np.ones(len(sets), dtype=bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (own[1:] != own[:-1])
    return sets[fresh], own[fresh]


def set_keys(texts: pa.Array) -> list[str | None]:
    """SHA-256 (hex) of each text's words, joined by a space; null without words. Equal keys mean equal runs of words."""
    words = [raw.split() for raw in texts.fill_null("").cast(pa.binary()).to_pylist()]
    return [hashlib.sha256(b" ".join(w)).hexdigest() if w else None for w in words]


def exact_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets, but a run is a number that stands for its words themselves: equal numbers, equal words.

    Words are numbered by a dictionary, then runs of two, three and more words by the numbers of their parts.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("").cast(pa.large_string())))
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    n -= np.bincount(np.repeat(np.arange(len(n)), n), weights=empty, minlength=len(n)).astype(np.int64)
    codes = flat.filter(pa.array(~empty)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    first = np.cumsum(n) - n
    runs = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(n)), runs)
    begin = np.repeat(first, runs) + np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)
    last, most = (first + n)[own], int(codes.max(initial=0)) + 1
    codes = np.append(codes, 0)
    run = np.zeros(len(own), dtype=np.int64)
    for k in range(words):
        here = np.where(begin + k < last, codes[np.minimum(begin + k, len(codes) - 1)], 0)
        run = np.unique(run * most + here, return_inverse=True)[1].reshape(-1)
    both = np.unique(own * (int(run.max(initial=0)) + 1) + run)
    return both % (int(run.max(initial=0)) + 1), both // (int(run.max(initial=0)) + 1)


def labels_of(sets: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Labels (texts x trees, as signed 64-bit integers) of non-empty sets; rows of empty sets are 0."""
    out = np.zeros((n, TREES), dtype=np.uint64)
    if not len(sets):
        return out.view(np.int64)
    first = np.searchsorted(own, np.arange(n + 1))
    full = np.flatnonzero(np.diff(first))
    factors = mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64)) | np.uint64(1)
    for f, a in enumerate(factors):
        least = np.minimum.reduceat(((sets * a) >> np.uint64(32)).astype(np.uint32), first[full])
        level = mix(least.astype(np.uint64) + a) & np.uint64(0xFF)
        out[full, f // LEVELS] |= level << np.uint64(8 * (LEVELS - 1 - f % LEVELS))
    return out.view(np.int64)


def sketches_of(labels: np.ndarray) -> np.ndarray:
    """One bit of every level of labels (texts x trees), as 64-bit integers (texts x 3): two texts agree in a bit with
    probability (1 + likeness) / 2."""
    bits = np.ascontiguousarray(labels).view(np.uint8).reshape(len(labels), TREES * LEVELS) & 1
    return np.packbits(bits, axis=1).view("<i8").reshape(len(labels), -1)


def least_agreement(threshold: float) -> int:
    """Bits of sketches that two texts of that likeness have in common but for a chance of 1 in 10 ** 9."""
    n, p = TREES * LEVELS, (1 + threshold) / 2
    return int(n * p - DEVIATIONS * np.sqrt(n * p * (1 - p)))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_bytes, set_key, labels and sketch of each document; set_key is null where a text has no words."""

    def run(batch: pa.RecordBatch) -> dict:
        texts, n = batch.column(1), batch.num_rows
        labels = labels_of(*shingle_sets(texts, words), n)
        return {"doc_id": batch.column(0), "n_bytes": pc.binary_length(texts.fill_null("")), "set_key": set_keys(texts), "labels": list(labels), "sketch": list(sketches_of(labels))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, set_key string, labels array<long>, sketch array<long>")


def links_in_groups(group: np.ndarray, ids: np.ndarray, sketch: np.ndarray, least: int, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect, within each group (equal neighbouring values), all rows whose sketches agree enough.

    Neighbours are linked if they agree. A group where some do not is cut there, and all rows of different pieces are
    compared. Where sure is true, neighbours of one group are linked whether they agree or not. sketch: unsigned integers.
    """
    agree = TREES * LEVELS - np.bitwise_count(sketch[1:] ^ sketch[:-1]).sum(axis=1, dtype=np.int64)
    same = group[1:] == group[:-1]
    near = same & ((agree >= least) | (sure[1:] & sure[:-1]))
    left, right = list(ids[:-1][near]), list(ids[1:][near])
    torn = np.flatnonzero(same & ~near)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    stop = np.append(start[1:], len(group))
    for g in np.unique(np.searchsorted(start, torn, side="right") - 1).tolist():
        a, b = int(start[g]), int(stop[g])
        if b - a < 3:
            continue
        piece = np.concatenate([[0], np.cumsum(~near[a : b - 1])])
        for i in range(a, b - 1):
            if (piece == piece[0]).all():
                break
            hit = np.flatnonzero(TREES * LEVELS - np.bitwise_count(sketch[i + 1 : b] ^ sketch[i]).sum(axis=1, dtype=np.int64) >= least) + i + 1 - a
            for j in hit[piece[hit] != piece[i - a]].tolist():
                if piece[j] != piece[i - a]:
                    left.append(ids[i])
                    right.append(ids[a + j])
                    piece[piece == piece[j]] = piece[i - a]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def forest_edges(labelled: DataFrame, depth: int, least: int) -> DataFrame:
    """Pairs (a, b) that connect all rows which share a prefix of at least depth levels in some tree and agree in least
    bits of their sketches.

    Rows (tree, label, id, sketch) are range-sorted, the id last, so no popular prefix fills a task. Texts that share a
    prefix stand next to each other, the longest shared prefixes nearest; links between neighbours connect them, from the
    deepest matches up the trie to the depth that the recall asks for. Strangers that merely share a prefix are not
    linked, so they chain no groups together, but for three cases where all neighbours of a prefix are linked, which only
    costs comparisons: its rows may go on in the next task, there are more than POPULAR of them, or they meet at the seam
    of two tasks (found on the driver, one pair a task).
    """
    low = np.int64(8 * (LEVELS - depth))
    names = ["a", "b", "part", "tree", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, begun = None, None, False

        def linked(rows: tuple, sure: np.ndarray) -> pa.RecordBatch:
            tree, label, ids, sketch = rows
            prefix = (label >> low) * TREES + tree
            a, b = links_in_groups(prefix, ids, sketch, least, sure)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *[pa.nulls(len(a), pa.int64())] * 3], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(i).to_numpy() for i in range(3)) + (np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(3, 6)], axis=1),)
            head = head or tuple(int(x[0]) for x in rows[:3])
            if held is not None:
                rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
            prefix = (rows[1] >> low) * TREES + rows[0]
            change = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            cut = int(change[-1]) if len(change) else 0
            if cut:  # all but the last group, of which the next batch may have more
                sure = np.zeros(cut, dtype=bool)
                sure[: 0 if begun else int(change[0])] = True
                yield linked(tuple(x[:cut] for x in rows), sure)
                held, begun = tuple(x[cut:] for x in rows), True
            elif len(prefix) > POPULAR:
                yield linked(rows, np.ones(len(prefix), dtype=bool))
                held, begun = tuple(x[-1:] for x in rows), False
            else:
                held = rows
        if head is not None:
            yield linked(held, np.ones(len(held[0]), dtype=bool))
            last, part = tuple(int(x[-1]) for x in held[:3]), TaskContext.get().partitionId()
            ends = [(head[2], None, 2 * part, head[0], head[1]), (last[2], None, 2 * part + 1, last[0], last[1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ends, strict=True)], names=names)

    rows = labelled.select(F.posexplode("labels").alias("tree", "label"), "id", *[F.col("sketch")[i].alias(f"s{i}") for i in range(3)]).withColumn("tree", F.col("tree").cast("long"))
    rows = rows.select("tree", "label", "id", "s0", "s1", "s2")
    found = rows.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id").mapInArrow(tidy(run), "a long, b long, part long, tree long, label long")
    found = written(found, "edges")
    ends = found.where("part IS NOT NULL").orderBy("part").collect()
    seams = [(min(x.a, y.a), max(x.a, y.a)) for x, y in zip(ends[1:-1:2], ends[2::2], strict=True) if x.tree == y.tree and (x.label ^ y.label) >> int(low) == 0 and x.a != y.a]
    return found.where("part IS NULL AND a <> b").select("a", "b").unionByName(docs_of(labelled, seams)).distinct()


def docs_of(like: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    return like.sparkSession.createDataFrame(pairs, "a long, b long")


def _jump(to: DataFrame) -> DataFrame:
    """to (id, to) with to replaced by where it points itself. What much points at is looked up by broadcast of at most 512 rows."""
    keyed = to.withColumn("key", F.col("to").cast("string"))
    above = to.groupBy("to").agg(F.count("*").alias("n")).join(to.select(F.col("id").alias("to"), F.col("to").alias("above")), "to")
    found = hot_lookup(keyed, above.select(F.col("to").cast("string").alias("key"), "n", "above"), "key", "n", to.count())
    return found.select("id", F.col("above").alias("to"))


def components(edges: DataFrame) -> DataFrame:
    """id and root (least id of its component) of every id in edges (a, b).

    In each round every id points at its least neighbour, then two steps further down, and the edges move along: those that end in
    one id are done. The graph shrinks from round to round until no edge is left; then the rounds' pointers are put
    together, the last first.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "to")
        to = written(_jump(written(_jump(to), "to")), "to")
        rounds.append(to)
        moved = now.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        now = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    roots = rounds.pop().withColumnRenamed("to", "root")
    while rounds:
        last = roots.select(F.col("id").alias("to"), "root")
        roots = written(rounds.pop().join(last, "to", "left").select("id", F.coalesce("root", "to").alias("root")), "roots")
    return roots


def overlaps(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Sizes of the intersections of the sets in a and b; each: hashes, number of the set of each, number of sets.

    Hashes in many sets go through a matrix product, a slice at a time; the others by listing their pairs of sets, which
    are few.
    """
    (ha, oa, na), (hb, ob, nb) = a, b
    values, ia = np.unique(ha, return_inverse=True)
    at = np.minimum(np.searchsorted(values, hb), max(len(values) - 1, 0))
    shared = values[at] == hb if len(values) else np.zeros(len(hb), dtype=bool)
    ib, ob = at[shared], ob[shared]
    ca, cb = np.bincount(ia, minlength=len(values)), np.bincount(ib, minlength=len(values))
    out = np.zeros((na, nb), dtype=np.float32)
    dense = np.flatnonzero(ca * cb > 1024)
    rank = np.full(len(values), -1)
    rank[dense] = np.arange(len(dense))
    for low in range(0, len(dense), 2048):
        x, y = np.zeros((na, 2048), dtype=np.float32), np.zeros((nb, 2048), dtype=np.float32)
        for m, i, o in ((x, rank[ia], oa), (y, rank[ib], ob)):
            here = (i >= low) & (i < low + 2048)
            m[o[here], i[here] - low] = 1
        out += x @ y.T
    sparse = rank[ia] < 0
    oa, ia = oa[sparse], ia[sparse]
    keep = rank[ib] < 0
    ob, ib = ob[keep], ib[keep]
    order = np.argsort(ib, kind="stable")
    ob, ib = ob[order], ib[order]
    first = np.searchsorted(ib, np.arange(len(values) + 1))
    for low in range(0, len(ia), 1 << 16):
        i, o = ia[low : low + (1 << 16)], oa[low : low + (1 << 16)]
        n = first[i + 1] - first[i]
        left = np.repeat(o, n)
        right = ob[np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out += np.bincount(left * nb + right, minlength=na * nb).reshape(na, nb).astype(np.float32) if na * nb <= 1 << 16 else _scatter(left * nb + right, na, nb)
    return out


def _scatter(cells: np.ndarray, na: int, nb: int) -> np.ndarray:
    out = np.zeros(na * nb, dtype=np.float32)
    cell, n = np.unique(cells, return_counts=True)
    out[cell] = n
    return out.reshape(na, nb)


def linked(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Whether each pair's Jaccard likeness reaches the threshold."""
    sa, sb = np.bincount(a[1], minlength=a[2])[:, None], np.bincount(b[1], minlength=b[2])[None, :]
    both = overlaps(a, b).astype(np.float64)
    return (both > 0) & (both * (1 + threshold) >= threshold * (sa + sb) - 1e-6)


def local_roots(ids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Least id that each document reaches over links (square, symmetric)."""
    root = ids.copy()
    while True:
        near = np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(root, near)
        if (now == root).all():
            return root
        root = now


def compare_groups(rows: DataFrame, threshold: float, words: int) -> DataFrame:
    """Compares the texts of each group block by block, by their runs of words themselves: id, root (least id reached
    within a task) and n_links, a row for each document and task it is in.

    rows: id, comp, blocks (how many the group has), block (its own), weight (documents with this set) and text. With
    more than one block a document goes to one task for each block. A task holds two blocks.
    """
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    dealt = rows.withColumn("pair", F.explode(others)).select("comp", "pair.i", "pair.j", "block", "id", "weight", "text")
    names = ["id", "root", "n_links"]

    def flush(group: list[tuple]) -> tuple:
        block, ids, weights, texts = zip(*group, strict=True)
        block, ids, weights = np.array(block), np.array(ids), np.array(weights)
        runs, own = exact_sets(pa.array(texts, pa.large_string()), words)
        cut = np.searchsorted(own, np.arange(len(ids) + 1))

        def side(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
            mine = [runs[cut[k] : cut[k + 1]] for k in chosen.tolist()]
            return np.concatenate(mine), np.repeat(np.arange(len(mine)), [len(x) for x in mine]), len(mine)

        links = np.zeros((len(ids), len(ids)), dtype=bool)
        left = np.flatnonzero(block == block.min())
        if block.min() == block.max():
            links = linked(side(left), side(left), threshold)
            np.fill_diagonal(links, False)
        else:
            right = np.flatnonzero(block == block.max())
            links[np.ix_(left, right)] = found = linked(side(left), side(right), threshold)
            links[np.ix_(right, left)] = found.T
        return ids, local_roots(ids, links), links @ weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for c, i, j, *row in zip(*cols, strict=True):
                if (c, i, j) != key:
                    if len(group) > 1:
                        out.append(flush(group))
                        if sum(len(x[0]) for x in out) > 10_000:
                            yield batch_of()
                    key, group = (c, i, j), []
                group.append(tuple(row))
        if len(group) > 1:
            out.append(flush(group))
        if out:
            yield batch_of()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "id").mapInArrow(tidy(run), "id long, root long, n_links long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999) -> DataFrame:
    """Classes of documents (doc_id, text; other columns are ignored) connected by links of Jaccard likeness >= threshold
    between their sets of word runs.

    Returns a row for each input row: doc_id, class_id (least doc_id of its class), n_links (other documents that it is
    linked to, those of the same words among them), copy_of (least doc_id with the same words) and n_copies. Documents of
    the same words are compared once, as one. Candidates share a prefix in some tree and are not far apart by their
    sketches; all pairs of a group that candidates connect are then compared by their words. A pair of likeness 0.8 fails
    to share a prefix with probability 1 - recall at most. Null texts count as empty; texts without words are alike to
    none; rows with a null doc_id are in no class (class_id null) and rows that repeat a doc_id share one. Pairs are
    counted where they are found and never become rows.
    """
    signed = written(signatures(docs, words), "signatures")
    known = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    one = F.min_by(F.struct("labels", "sketch", "n_bytes"), "doc_id").alias("one")
    sets = written(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), one).select("set_key", "id", "n_copies", "one.*"), "sets")
    roots = components(forest_edges(sets.select("id", "labels", "sketch"), depth_for(threshold, recall), least_agreement(threshold)))
    members = written(roots.join(sets.groupBy("id").agg(F.sum("n_copies").alias("weight"), F.sum("n_bytes").alias("n_bytes")), "id"), "members")
    sizes = members.groupBy(F.col("root").cast("string").alias("key")).agg(F.count("*").alias("size"), F.sum("n_bytes").alias("bytes"))
    groups = hot_lookup(members.withColumn("key", F.col("root").cast("string")), sizes, "key", "size", members.count())
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    groups = groups.select("id", F.col("root").alias("comp"), blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "weight")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(groups.hint("merge"), "id").select("id", "comp", "blocks", "block", "weight", "text")
    found = written(compare_groups(texts, threshold, words), "links")
    links = found.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("root").alias("root"), F.count("*").alias("n"))
    settled = links.where("n = 1 AND n_links > 0").select("id", "root")
    apart = found.join(links.where("n > 1").select("id"), "id", "left_semi").where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    classes = settled.unionByName(components(apart))
    known_sets = sets.select("set_key", "id", "n_copies").join(classes, "id", "left").join(links.select("id", "n_links"), "id", "left")
    known_sets = known_sets.select("set_key", F.col("id").alias("copy_of"), "n_copies", F.coalesce("root", "id").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    keyed = signed.select("doc_id", F.coalesce("set_key", F.lit("none")).alias("set_key"))
    out = hot_lookup(keyed, known_sets, "set_key", "n_copies", signed.count())
    known_row = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.when(known_row, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known_row, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
        F.when(known_row, F.coalesce("copy_of", "doc_id")).alias("copy_of"), F.when(known_row, F.coalesce("n_copies", F.lit(1))).otherwise(1).alias("n_copies"),
    )


def keep_one_a_class(docs: DataFrame, **options) -> DataFrame:
    """One row of each class and all rows in none, with all their columns: the least doc_id stays, nulls first, then the
    least text hash. Every row is judged by its own text; of rows that repeat both doc_id and text one stays."""
    rows, plain = keyed(docs)
    rows = rows if plain else rows.dropDuplicates(["key"])
    dropped = near_duplicates(rows.select(F.col("key").alias("doc_id"), "text"), **options).where("class_id <> doc_id").select(F.col("doc_id").alias("key"))
    return unpacked(rows.join(dropped, "key", "left_anti"), docs.columns)
