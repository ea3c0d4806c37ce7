"""The ten operators against brute force on odd rows, and the cases that their docstrings define."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreline.llm import (
    byte_bpe, chunk_dedup, curve_packing, host_reputation, importance_resampling, minhash_forest, rare_feature_digest, suffix_dedup, token_count, token_files, tokenizer_files,
)
from loreline.llm.common import hot_lookup, scratch_path
from loreline.llm.induced_sorting import induced_order
from loreline.llm.tokenizer_files import public_path, split_pattern

RANKS, JSON, WORDS, PIECES = (public_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [(1, "same"), (1, "same"), (None, "same"), (None, None), (2, None), (2, "")]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


# ---- 1 exact dedup


def test_exact_dedup(docs, rows, none, odd):
    got, groups = by_id(chunk_dedup.exact_dedup(docs)), defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    for i, t, *_ in rows:
        g, r = groups[t or ""], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    assert chunk_dedup.exact_dedup(none).count() == 0
    same = [r for r in chunk_dedup.exact_dedup(odd).collect() if r.text_sha256 == hashlib.sha256(b"same").hexdigest()]
    assert sorted(((r.doc_id, r.kept) for r in same), key=str) == [(1, True), (1, True), (None, False)]
    assert {r.doc_id for r in chunk_dedup.drop_copies(docs).select("doc_id").collect()} == {max(g) for g in groups.values()}
    assert chunk_dedup.drop_copies(docs).columns == docs.columns


def test_chunks_make_up_the_text_and_clashes_are_told_apart(spark, docs, monkeypatch):
    cut = docs.select("text", F.concat_ws("", chunk_dedup.chunks_of(F.coalesce("text", F.lit("")))).alias("back")).collect()
    assert all((r.text or "") == r.back for r in cut)
    monkeypatch.setattr(chunk_dedup.F, "xxhash64", lambda c: F.length(c).cast("long") if isinstance(c, str) else F.length(c).cast("long"))
    made = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz")], "doc_id long, text string")
    keys = {r.doc_id: tuple(r.recipe) for r in chunk_dedup.chunk_recipes(made).collect()}
    assert keys[1] == keys[3] != keys[2] and len(keys[4][0]) < 64 < len(keys[1][0])


# ---- 2 quality


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(5)
    good, bad = "river stone light wind field".split(), "BUY!! ### win$$ click>> now!!".split()
    docs = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(40))) for i in range(1200)] + [(5000, None), (5001, ""), (None, "river wind")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 4 != 0) for i in range(800)] + [(3, True), (None, True)], "doc_id long, target boolean")
    out = importance_resampling.resample(df, labels)
    got = by_id(out)
    assert out.count() == len(docs)
    held = range(800, 1200)
    assert sum(got[i].selected for i in held if i % 4) >= 0.97 * 300 and not any(got[i].selected for i in held if i % 4 == 0)
    kept = {r.doc_id for r in importance_resampling.keep_selected(df, labels).collect()}
    assert kept == {i for i, r in got.items() if r.selected}
    assert importance_resampling.resample(df.where("doc_id < 0"), labels).count() == 0
    assert importance_resampling.resample(df, labels.where("doc_id < 0")).where("selected").count() == len(docs)


def test_log_weights(spark):
    """Against the models written out by hand: every text is left out of the counts that weigh it."""
    rng = random.Random(7)
    words = "ab cd ef gh ij".split()
    rows = [(i, " ".join(rng.choices(words[: 3 + i % 3], k=rng.randrange(9)))) for i in range(60)] + [(60, None), (61, "")]
    labels = [(i, i % 3 == 0) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judge = importance_resampling.train(docs, spark.createDataFrame(labels, "doc_id long, target boolean"))
    fitted = {r.doc_id for r in judge.model.fitted.collect()}
    assert 0 < len(fitted) < 20 and all(i % 3 == 0 and i < 50 for i in fitted)

    def grams(t):
        w = (t or "").split()
        return Counter([*w, *zip(w, w[1:])])

    raw, target = sum((grams(t) for _, t in rows), Counter()), sum((grams(t) for i, t in rows if i in fitted), Counter())
    share, prior = sum(target.values()) / sum(raw.values()), importance_resampling.PRIOR
    got = by_id(judge.judge(docs))
    for i, t in rows:
        mine = grams(t)
        want = sum(n * math.log((target[g] - (n if i in fitted else 0) + prior * share) / ((raw[g] - n + prior) * share)) for g, n in mine.items())
        assert got[i].log_weight == pytest.approx(want)


def test_k_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, "river wind " * (1 + i % 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "doc_id long, target boolean")
    out = importance_resampling.resample(docs, labels, k=7).collect()
    best = {r.doc_id for r in sorted(out, key=lambda r: (-r.key, r.doc_id))[:7]}
    assert {r.doc_id for r in out if r.selected} == best == {r.doc_id for r in importance_resampling.keep_selected(docs, labels, k=7).collect()}


def test_top_k_is_exact(spark):
    rng = random.Random(1)
    keys = [(i, rng.choice([rng.random(), 0.5])) for i in range(500)]
    df = spark.createDataFrame(keys, "doc_id long, key double")
    order = sorted(keys, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 7, 200, 333, 499, 500, 900):
        assert {r.doc_id for r in importance_resampling.gumbel_top_k(df, k).where("selected").collect()} == {i for i, _ in order[:k]}


# ---- 3 hosts


def test_hosts_and_rules(spark):
    urls = ["https://WWW.Example.com/en/a?x#y", "http://a.b.net/es/1", "b.net/es/", None, "x://h", "http://notexample.com/en/q", "https://example.com/en/z", "ftp://q.net/fr", "http://H.org?x/y", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = [host_reputation.Rule(a, t) for a, t in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]
    outcomes = spark.createDataFrame([(i, True) for i in range(10)], "page_id long, good boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.filter_urls(pages, outcomes, rules).collect()}
    assert got == {
        0: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 1: ("a.b.net", "/es/1", "net/es/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("h", "", None, "allow"),
        5: ("notexample.com", "/en/q", "com/", "allow"), 6: ("example.com", "/en/z", "example.com/en/", "block"), 7: ("q.net", "/fr", None, "allow"), 8: ("h.org", "", None, "allow"), 9: ("b:", "//c/d", None, "allow"),
    }
    assert host_reputation.filter_urls(pages.limit(0), outcomes, rules).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [(f"good{i % 5}.one.com", True) for i in range(500)] + [("bad.two.com", False)] * 100 + [("tiny.one.com", False)]
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "page_id long, host string")
    out = {r.host: r for r in host_reputation.host_reputation(pages, spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "page_id long, good boolean")).collect()}
    assert out["bad.two.com"].verdict == "block" and out["good0.one.com"].verdict == "allow" and out["tiny.one.com"].verdict == "allow" and 0 < out["tiny.one.com"].mean < out["good0.one.com"].mean
    assert host_reputation.concentration(spark.createDataFrame([("p", 5, 2)], "parent string, n long, good long")) == 1000.0


def test_spread_is_measured_within_the_parent(spark):
    """Groups that differ only as their parents do are alike; groups that differ within a parent are not."""
    rng = random.Random(3)
    draw = lambda p, n: sum(rng.random() < p for _ in range(n))
    alike = [(f"p{k}", 200, draw(0.1 + 0.8 * (k % 2), 200)) for k in range(10) for _ in range(20)]
    apart = [("p", 200, draw(rng.betavariate(4, 4), 200)) for _ in range(300)]
    made = lambda rows: spark.createDataFrame(rows, "parent string, n long, good long")
    assert host_reputation.concentration(made(alike)) > 200 and 5.5 < host_reputation.concentration(made(apart)) < 11


def test_suffixes(spark, tmp_path):
    (tmp_path / "list").write_text("// remark\ncom\nco.uk\n*.ck\n!www.ck\na.b.no  more\n\n")
    suffixes = host_reputation.read_suffixes(str(tmp_path / "list"))
    hosts = {"x.y.co.uk": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"), "q.w.com": ("com", "w.com"), "com": ("com", "com"), "z.y.a.b.no": ("a.b.no", "y.a.b.no"), "b.no": ("no", "b.no"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", host_reputation.suffix_of(F.col("host"), suffixes).alias("s"), host_reputation.domain_of(F.col("host"), suffixes).alias("d"))
    assert suffixes == ("co.uk", "a.b.no") and {r.host: (r.s, r.d) for r in df.collect()} == hosts


# ---- 4 fingerprints


class BruteDigest:
    """The digest window by window, in plain Python."""

    def __init__(self, texts):
        counts = Counter(e for t in texts for e in self.entropies(t.encode()))
        order = sorted(range(1001), key=lambda e: (counts[e], e))
        self.rank = {e: k for k, e in enumerate(order)} | {e: 2000 - e for e in range(100)}

    @staticmethod
    def entropies(raw):
        scale, out = 1 << 20, []
        for i in range(len(raw) - 63):
            sums = sum(round(c * math.log2(c) * scale) for c in Counter(raw[i : i + 64]).values())
            out.append((6 * 64 * scale - sums) * 1000 // (6 * 64 * scale))
        return out

    def features(self, raw):
        keys = [(self.rank[e], i) for i, e in enumerate(self.entropies(raw))]
        wins = Counter(min(keys[i : i + 64])[1] for i in range(len(keys) - 63))
        return sorted(i for i, n in wins.items() if n >= 16) or [min(wins, key=lambda i: (-wins[i], i)) if wins else min(keys)[1]]

    def bits(self, raw):
        if not raw:
            return np.zeros((0, 2048), np.uint8)
        raw, m, p = raw.ljust(64, b"\0"), (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1
        chosen = self.features(raw)
        out = np.zeros((-(-len(chosen) // 160), 2048), np.uint8)
        for k, i in enumerate(chosen):
            x = sum((b + 1) * pow(p, j, 1 << 64) for j, b in enumerate(raw[i : i + 64])) & m
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
            x ^= x >> 31
            for probe in range(5):
                out[k // 160, x >> 11 * probe & 2047] = 1
        return out


def test_fingerprints(docs, rows, none, spark):
    got = by_id(rare_feature_digest.fingerprint_neighbours(docs))
    texts, n = [t or "" for _, t, *_ in rows], len(rows)
    brute = BruteDigest(texts)
    one = functools.cache(lambda t: brute.bits(t.encode()))
    for i, t in enumerate(texts):
        half, after, r = len(t) // 2, texts[(i + 1) % n], got[i]
        edited = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == rare_feature_digest.as_string(one(t)) and r.edited_fingerprint == rare_feature_digest.as_string(one(edited))
        assert r.near_next == pytest.approx(rare_feature_digest.likeness(one(t), one(after))) and 0 <= r.near_edited <= 1
        assert t == "" or rare_feature_digest.likeness(one(t), one(t)) == 1
    assert got[6].fingerprint == got[7].fingerprint and got[6].near_next == 1 and got[0].fingerprint == "0:"
    assert rare_feature_digest.fingerprint_neighbours(none).count() == 0
    lone = spark.createDataFrame([(7, "abc def")], "doc_id long, text string")
    assert rare_feature_digest.fingerprint_neighbours(lone).first().near_next == 1
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    assert rare_feature_digest.fingerprint_neighbours(odd).count() == len(ODD)


def test_parts_of_a_long_text_have_its_features():
    ranks = rare_feature_digest.rarity(np.random.default_rng(1).integers(0, 99, 1001))
    for data in (bytes(random.Random(3).choices(b"abcdefgh ", k=1_200_000)), b"x" * 1_200_000, b"ab" * 300_000 + b"abc" * 200_000, bytes(range(70, 90)) * 60_000):
        whole = rare_feature_digest.features_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ranks)[1]
        assert rare_feature_digest.long_features(data, ranks).tolist() == whole.tolist()


# ---- 5 near duplicates


def jaccard_links(rows, words=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ids = sorted(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def near_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return list(enumerate([*out, *out[:4], None, "", "one two", "one two", "solo"]))


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates(spark, none, monkeypatch, block):
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).repartition(3)
    got, links = by_id(minhash_forest.near_duplicates(df)), jaccard_links(rows)
    want = brute_classes(rows, links)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == want
    assert {r.doc_id for r in minhash_forest.keep_one_a_class(df).collect()} == {top for top, _ in want.values()}


def test_near_duplicates_odd(odd, none, docs):
    assert minhash_forest.near_duplicates(none).count() == 0
    assert {(r.doc_id, r.class_id) for r in minhash_forest.near_duplicates(odd).collect()} == {(1, 1), (2, 2), (None, None)}
    assert minhash_forest.near_duplicates(docs).count() == docs.count()


def brute_classes(rows, links):
    degree, up = Counter(), {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (top(i), degree[i]) for i, _ in rows}


def test_words_that_hash_alike_are_told_apart(spark):
    """Two words of 22 letters that a polynomial hash of a fixed base cannot tell apart, repeated: likeness 0."""
    words = [t[-22:] for t in TWINS]
    rows = [(1, " ".join([words[0]] * 18)), (2, " ".join([words[1]] * 18)), (3, " ".join(["x", *[words[0]] * 18])), (4, " ".join([words[0]] * 17))]
    got = {i: (r.class_id, r.n_links, r.n_copies) for i, r in by_id(minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    assert got == {1: (1, 1, 1), 2: (2, 0, 1), 3: (3, 0, 1), 4: (1, 1, 1)}


def test_exact_sets():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab é", k=rng.randrange(9))) for _ in range(60)] + [" \n", "", "a b", "a\tb\x0c a", None]
    runs, own = minhash_forest.exact_sets(pa.array(texts), 3)
    mine = [set(runs[own == k].tolist()) for k in range(len(texts))]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set() for w in ((t or "").encode().split() for t in (a, b)))
            assert len(mine[i] & mine[j]) == len(x & y) and len(mine[i]) == len(x)


def test_links_in_groups_connect_all_that_agree():
    rng = np.random.default_rng(6)
    group, kind = np.sort(rng.integers(0, 40, 600)), rng.integers(0, 4, 600)
    base = rng.integers(0, 1 << 63, (4, 3), dtype=np.uint64)
    sketch = base[kind] ^ (np.uint64(1) << rng.integers(0, 63, (600, 3), dtype=np.uint64))
    for sure in (np.zeros(600, bool), group == 7):
        a, b = minhash_forest.links_in_groups(group, np.arange(600), sketch, 170, sure)
        assert (group[a] == group[b]).all() and ((kind[a] == kind[b]) | sure[a]).all()
        classes = brute_classes([(i, None) for i in range(600)], list(zip(a.tolist(), b.tolist())))
        want = defaultdict(set)
        for i in range(600):
            want[(group[i], -1 if sure[i] else kind[i])].add(classes[i][0])
        assert all(len(x) == 1 for x in want.values())


def test_recall_on_whole_documents(spark):
    """Against all pairs of the 1,000 documents of sf0.01: no link and no class is lost or made up."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    owners, sets, links = defaultdict(list), {}, []
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        both = Counter(j for s in sets[i] for j in owners[s])
        links += [(j, i) for j, n in both.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            owners[s].append(i)
    got = {i: (r.class_id, r.n_links) for i, r in by_id(minhash_forest.near_duplicates(docs)).items()}
    want = brute_classes(rows, links)
    found = sum(got[i][1] for i, _ in rows)
    assert len(links) > 50 and found >= 0.9 * 2 * len(links) and all(got[i][1] <= want[i][1] for i, _ in rows) and got == want


def test_depth_reaches_recall():
    d = minhash_forest.depth_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** minhash_forest.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** minhash_forest.TREES


# ---- 6, 8, 9 tokens


def tiktoken_ids(text):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=tokenizer_files.load_ranks(RANKS), special_tokens={})
    return enc.encode_ordinary(text)


def test_byte_bpe(docs, rows, none):
    got, coded = by_id(byte_bpe.round_trip(docs, RANKS)), byte_bpe.encode(docs, RANKS)
    ids, back = by_id(coded), by_id(byte_bpe.decode(coded, RANKS))
    for i, t, *_ in rows:
        want = tiktoken_ids(t or "")
        assert list(ids[i].ids) == want and bytes(back[i].decoded) == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert byte_bpe.round_trip(none, RANKS).count() == 0


PARTS = [*"abcdeABé ñß,.!?'\n\t  123«…ςΣİ漢😀<|>", "<|endoftext|>", "'s", "the ", "n't "]
TEXT = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_encoders_agree_with_their_libraries(text):
    e = byte_bpe.encoder(RANKS, split_pattern())
    (ids,) = e.encode([text])
    assert ids == tiktoken_ids(text) and e.decode(ids) == text.encode()
    for path in (JSON, WORDS):
        want = tokenizer_files.load_tokenizer(path).encode(text, add_special_tokens=False).ids
        got, _ = tokenizer_files.encode_texts(pa.array([text]), path)
        assert got.tolist() == want and token_count.count_texts([text], path) == [len(want)]


def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(60) for b in range(50)]
    table = byte_bpe.PerfectHash(keys, list(range(len(keys))))
    assert table.lookup(keys) == list(range(len(keys))) and table.lookup([b"\xff\xff", b"", b"abc"]) == [-1] * 3
    assert sorted(table.keys) == sorted(keys)


@pytest.mark.parametrize("path", [JSON, WORDS, PIECES])
def test_counts(docs, rows, none, path):
    got = by_id(token_count.count_tokens(docs, path, 100))
    for i, t, *_ in rows:
        t = t or ""
        n = len(tokenizer_files.load_pieces(path).encode(t)) if path == PIECES else len(tokenizer_files.load_tokenizer(path).encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 100)
    assert token_count.count_tokens(none, path).count() == 0


def test_proven_tokens_are_proven():
    tok = tokenizer_files.load_tokenizer(JSON)
    proven = token_count.proven_tokens(JSON)
    assert len(proven) > 40_000 and all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in sorted(proven)[::500])


def test_token_files(spark, docs, rows, none, odd):
    path = scratch_path(spark, "files")
    token_files.write_token_files(docs, path, WORDS)
    read = token_files.read_token_files(spark, path)
    got, sums, start = by_id(read), by_id(token_files.checksums(read)), 0
    for i, t, *_ in rows:
        want = np.array([*tokenizer_files.load_tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert list(got[i].ids) == want.tolist()
        assert (sums[i].start, sums[i].n_tokens, sums[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert [r.doc_id for r in token_files.find_documents(spark, path, [3, 9, 999]).orderBy("doc_id").collect()] == [3, 9]
    for df, n in ((none, 0), (odd, len(ODD))):
        path = scratch_path(spark, "files")
        token_files.write_token_files(df, path, WORDS)
        assert token_files.checksums(token_files.read_token_files(spark, path)).count() == n


# ---- 7 suffix order and repeats


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([3, 20, 100]), st.sampled_from([64, 1 << 28]), st.sampled_from([0, 1 << 22]))
def test_induced_order(values, depth, limit, base):
    text = np.array(values + values[: len(values) // 2], dtype=np.int64)
    order, common = induced_order(text, depth, limit, base)
    heads = [tuple(text[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
    for i in range(1, len(heads)):
        a, b = heads[i - 1], heads[i]
        assert common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def shard_of(rng):
    """Stretches as they meet in a shard: shared passages of many letters, cut anywhere, between words of their own."""
    letters = rng.choice(["ab", "abcd ", "".join(map(chr, range(33, 127))), "".join(map(chr, range(97, 123))) + " "])
    noise = lambda n: "".join(rng.choices(letters, k=n))
    shared = [noise(rng.randrange(20, 260)) for _ in range(rng.randrange(1, 4))]
    out = []
    for key in range(rng.randrange(2, 60)):
        s = rng.choice(shared)
        a, b = sorted(rng.sample(range(len(s) + 1), 2))
        out.append((key, (noise(rng.randrange(30)) + s[a:b] + noise(rng.randrange(30)) + rng.choice([s[:b], ""])).encode()))
    return out


@pytest.mark.parametrize("match", [8, 20, 100])
@pytest.mark.parametrize("base", [0, 1 << 22])
def test_shards_of_shared_passages(match, base):
    rng = random.Random(match + base)
    for _ in range(80):
        rows = [r for r in shard_of(rng) if len(r[1]) >= match]
        if not rows:
            continue
        segments = [(k, min(len(d) - match + 1, 255) << 8, d[: match + 254]) for k, d in rows]
        got = {(k, (p >> 16) + j) for k, p in suffix_dedup.repeats_in_shard(segments, match, base=base) for j in range(p >> 8 & 255)}
        seen, want = set(), set()
        for k, _, d in segments:
            for j in range(len(d) - match + 1):
                want |= {(k, j)} if d[j : j + match] in seen else set()
                seen.add(d[j : j + match])
        assert got == want


@settings(max_examples=100, deadline=None)
@given(st.data(), st.sampled_from([70, 300, 5000]), st.sampled_from([3, 20, 100]), st.sampled_from([0, 1 << 22]))
def test_induced_order_of_wide_alphabets(data, letters, depth, base):
    shared = data.draw(st.lists(st.integers(1, letters), min_size=1, max_size=130))
    parts = data.draw(st.lists(st.tuples(st.integers(0, len(shared)), st.integers(0, len(shared)), st.lists(st.integers(1, letters), max_size=12)), max_size=10))
    text = np.array([c for a, b, more in parts for c in [*shared[min(a, b) : max(a, b)], *more, 0]] or [0], dtype=np.int64)
    order, common = induced_order(text, depth, base=base)
    heads = [tuple(text[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)
    for i in range(1, len(heads)):
        a, b = heads[i - 1], heads[i]
        assert common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_repeats(rows, match):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - match + 1):
            if raw[p : p + match] in seen:
                gone[p : p + match] = True
            seen.add(raw[p : p + match])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("match", [100, 12])
def test_suffix_dedup(docs, rows, none, match):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, match).collect()}
    rows = [(i, t) for i, t, *_ in rows]
    assert got == brute_repeats(rows, match)
    assert suffix_dedup.suffix_dedup(none).count() == 0


#: Two strings of 100 bytes that a polynomial hash modulo 2 ** 64 of a fixed base cannot tell apart.
TWINS = [" vgjjspqmsbphxzmnvflrwyvxlcovqdyfq mlpxapbjwtssmuffqhaygrrhmqlsloivrtxamz xqze" + t for t in ("mmmmmmmmmmmmmmmmmmmmmm", "opmlqklnmrokkojilmlkok")]


def hot_rows():
    """One line in most documents, each time between other words, and one long passage in some."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, passage = noise(110), noise(400)
    return [(i, noise(rng.randrange(90)) + (passage if i % 5 == 0 else line) + noise(rng.randrange(150)) + (line if i % 7 == 0 else "")) for i in range(80)]


def counts_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_twins_of_a_polynomial_hash_stay(spark):
    got = counts_of(suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(TWINS)), "doc_id long, text string")))
    assert [got[i][:3] for i in (0, 1)] == [(100, 0, 0)] * 2


@pytest.mark.parametrize("constant", [False, True])
@pytest.mark.parametrize("split", [3, 40, 2048])
def test_hot_groups_are_split_and_hashes_decide_nothing(spark, monkeypatch, constant, split):
    """split: different stretches that are sorted together; with a constant hash all stretches share one group."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)  # workers see what is patched here
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 2)
    if constant:
        monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * np.uint64(0))
    try:
        rows = hot_rows() + [(100 + i, t) for i, t in enumerate(TWINS)]
        assert counts_of(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute_repeats(rows, 100)
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_classes_hold_all_places():
    data = np.frombuffer(random.Random(2).randbytes(600), np.uint8)
    first, sizes, off, _ = suffix_dedup.stretches(data, np.array([0, 600]))
    for width in (9, 1, 69):
        owner, f, n, o, group = suffix_dedup.classes_of(data, first, sizes, off, width, 100)
        places = [p for a, k in zip(f, n) for p in range(a, a + k)]
        assert sorted(places) == list(range(501)) and (f + o == (first + off)[owner]).all() and len(set(group)) == len(group)


def test_suffix_dedup_odd_ids(spark):
    made = spark.createDataFrame([(1, "x" * 300), (1, "x" * 300), (None, "y" * 150), (2, "y" * 150), (2, ""), (3, "é" * 120)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(made).collect())
    assert got == [("1", 300, 299), ("1", 300, 299), ("2", 0, 0), ("2", 150, 150), ("3", 240, 238), ("None", 150, 149)]


def test_cut_repeats_keeps_columns(docs):
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == 0 and out.count() == docs.count()


def test_cut_repeats_keeps_odd_ids(spark):
    a, b, c = ("".join(chr(97 + (i * i * k) % 23) for i in range(n)) for k, n in ((3, 90), (5, 80), (7, 70)))
    rows = [(None, a, "x"), (None, a, "y"), (1, b, "z"), (1, b, "z"), (1, c, "u"), (2, c, "v")]
    out = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plain = lambda x: sorted(map(str, x))
    assert plain(tuple(r) for r in out.collect()) == plain(rows)


def test_dropping_copies_judges_rows(spark):
    """A row goes for its own text, not for that of another row of its doc_id; null ids are told as well, and of equal rows
    one stays."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "pq")
    rows = [(1, a), (1, b), (2, a), (2, a), (None, a), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, chunk_dedup.drop_copies(docs).collect())) == Counter([(1, b), (2, a), (None, "alone")])
    rows = [(1, a), (3, f"{a} more"), (3, b), (3, b), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash_forest.keep_one_a_class(docs).collect())) == Counter([(1, a), (3, b), (4, None), (5, None)])
    docs = spark.createDataFrame([*rows, (None, a), (None, a)], "doc_id long, text string")
    assert Counter(map(tuple, minhash_forest.keep_one_a_class(docs).collect())) == Counter([(None, a), (3, b), (4, None), (5, None)])


CLASHING = ["_key", "_id", "_fitted", "_kept", "_log_weight", "_text", "key", "rest", "id", "of", "kept", "sha", "root", "selected", "class_id", "group", "place", "chosen", "value"]


def test_stages_keep_columns_of_any_name(spark):
    texts = ["the river runs past the old mill and on to the sea " * 4, None, "", "a short text"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in CLASHING})
    labels = spark.createDataFrame([(0, True), (3, True)], "doc_id long, target boolean")
    for stage in (chunk_dedup.drop_copies, minhash_forest.keep_one_a_class, suffix_dedup.cut_repeats, lambda d: importance_resampling.keep_selected(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASHING)


# ---- 10 packing


def test_hilbert_curve_moves_by_one():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = curve_packing.hilbert_keys(cells, 3)
    walk = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, rows, none, odd):
    pieces = curve_packing.pack(docs, JSON).collect()
    want = {i: np.array([*tokenizer_files.load_tokenizer(JSON).encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t, *_ in rows}
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_seq[p.sequence_id].append(p)
    assert set(of_doc) == set(want)
    for i, ps in of_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want[i]), zlib.crc32(want[i][at : at + p.length].tobytes()))
            at += p.length
        assert at == len(want[i])
    for ps in of_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    assert curve_packing.pack(none, JSON).count() == 0 and curve_packing.pack(odd, JSON).count() == len(ODD)
    with pytest.raises(ValueError):
        curve_packing.pack(docs, JSON, 1000)


# ---- helpers


def test_hot_lookup(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "doc_id long, key string")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    got = hot_lookup(left, right, "key", "n", 300, parts=4)
    assert got.count() == 300 and {r.top for r in got.where("key = 'hot'").collect()} == {299} and got.where("key <> 'hot' AND top <> doc_id").count() == 0
