"""Phrases, host rules and whitening against brute force, and the cases that their docstrings define."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreline.llm import host_rules, phrase_bitmaps, whitening

# ---- 11 phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, longest, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * f[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    out = []
    for lang in {p[0] for p in found}:
        mine = []
        for (of, p), a in found.items():
            if of == lang and (of, p) not in covered:
                score, _, l, r = min((2000000 * a // (f[of, p[:k]] + f[of, p[k:]]), k, f[of, p[:k]], f[of, p[k:]]) for k in range(1, len(p)))
                mine.append((" ".join(p), a, l, r, n[lang], score))
        mine.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(mine[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "The", "a", "of", "é漢", "river", "😀", "\x00x", "stone\x85", "aa"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), rng.choice(["", "over and over again " * 3]) + text))
    return rows + [("en", None), ("en", ""), (None, "a a a a a a a a a a a a a a a a a a a"), ("long", "word " * 5000), ("one", "x" * 3000), ("en", " .,;")]


@pytest.mark.parametrize("size, together", [(8 << 20, 1 << 19), (200, 7)])
def test_collocations(spark, monkeypatch, size, together):
    monkeypatch.setattr(phrase_bitmaps, "TOGETHER", together)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, text string, word long").repartition(3)
    out = phrase_bitmaps.collocations(docs, least=5, top=12, size=size)
    assert sorted(map(tuple, out.collect())) == brute_phrases(rows, 4, 5, 12)
    assert dict(out.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}


def test_collocations_of_nothing(spark):
    assert phrase_bitmaps.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrase_bitmaps.collocations(spark.createDataFrame([("en", "one two. three"), (None, None)], "lang string, text string")).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(phrase_bitmaps.Filter, "holds", lambda self, h: np.ones(len(h), dtype=bool))
    assert sorted(map(tuple, phrase_bitmaps.collocations(docs, least=5, top=12).collect())) == brute_phrases(rows, 4, 5, 12)


def test_products_beyond_64_bits(spark):
    big = 3 << 61
    phrases = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, k int, a long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", None, big)], "lang string, word string, f long")
    r = phrase_bitmaps.scored(phrases, words, 4).first()
    assert (r.score, r.l, r.r) == (2000000 * big // (2 * big + 1), big, big + 1)
    longer = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, 1 + big // 5 * 4)], "lang string, phrase string, k int, a long")
    kept = lambda a: phrase_bitmaps.uncovered(longer.where("k = 2").union(longer.where("k = 3").withColumn("a", F.lit(a).cast("long"))), longer.select("lang", "phrase", "a").where("phrase = 'a b'"), 4).count()
    assert (kept(-(-big * 4 // 5)), kept(-(-big * 4 // 5) - 1)) == (0, 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "a.b", "d,", "\n"]), max_size=80))
def test_bitmaps_of_a_shard(words):
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    shard = phrase_bitmaps.Shard("en", data)
    names = [w.decode() for w in shard.vocab.to_pylist()]
    got = Counter()
    for found, n in phrase_bitmaps.mine(shard, np.ones(len(names), dtype=bool), lambda a, b: np.ones(len(a), dtype=bool), 4):
        for row, k in zip(found.tolist(), n.tolist(), strict=True):
            got[tuple(names[i] for i in row)] += k
    want = Counter()
    for piece in re.split(r"[.,\n]", " ".join(words)):
        ws = piece.split()
        want.update(tuple(ws[i : i + k]) for k in (2, 3, 4) for i in range(len(ws) - k + 1))
    assert got == want


# ---- 12 host rules


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t\x0b", "a", "a b c d e a b c d e", "x " * 30, "one\none\n\n one\none", "# * $ 100% & | < >", "é漢😀 é漢😀 w v", "l1\r\nl1\r\nl1", "p q r s t u\np q r s t u\nv", "z" * 5000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(TEXTS), st.text(alphabet="ab \n#é\t", max_size=60)), max_size=12))
def test_measures(texts):
    got = list(zip(*(x.tolist() for x in host_rules.measured(pa.array(texts, pa.string()))), strict=True))
    assert got == [brute_measures(t) for t in texts]


def test_host_rules(spark, docs, rows, none):
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        m, r = brute_measures(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and (not r.base_failed or not r.kept)
    assert host_rules.judge(none).count() == 0


def test_domains_are_shrunk_and_judged(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("river stone light wind field water".split()) + str(rng.randrange(10**6)) for _ in range(25))
    marks = lambda: prose().replace(" ", " #")
    rows = [(f"good{h}", prose()) for h in range(8) for _ in range(40)] + [("spam", marks() if i % 20 else prose()) for i in range(60)] + [("small", marks())] + [(None, prose()), (None, "short"), ("", prose())]
    docs = spark.createDataFrame([(i, t, h, "x", True) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, domain string, kept boolean").repartition(4)
    out = host_rules.judge(docs)
    got = {r.doc_id: r for r in out.collect()}
    for i, (h, t) in enumerate(rows):
        assert got[i].domain_rejected == (h == "spam") and got[i].kept == (h != "spam" and t != "short")
    v = {r.domain: r for r in host_rules.domain_verdicts(host_rules.features(docs, "source")).collect()}
    sums = {h: (n, k) for h, (n, k) in {h: (sum(1 for x, _ in rows if x == h), sum(1 for x, t in rows if x == h and "#" in t)) for h in {x for x, _ in rows if x is not None}}.items()}
    n, k = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    p, m = k / n, len(sums)
    between = sum(b * b / a for a, b in sums.values()) - n * p * p - p * (1 - p) * (m - 1)
    most = p * (1 - p) * (n - sum(a * a for a, _ in sums.values()) / n - (m - 1))
    strength = 1 / min(max(between / most, 1 / 1001), 0.5) - 1
    for h, (a, b) in sums.items():
        assert math.isclose(v[h].rate_symbols, (b + strength * p) / (a + strength), rel_tol=1e-9)
    assert v["small"].rate_symbols < 0.9 < v["spam"].rate_symbols + 0.1 and not v["small"].rejected
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).withColumn("doc_id", F.lit(None).cast("long"))
    assert host_rules.judge(twice).count() == 6


# ---- 13 whitening


def brute_whitening(rows, k):
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, x = len(fit), np.array(fit, dtype=object)
    sums = x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    to = vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    out = {}
    for i, v in good:
        d = np.array(v, dtype=object) * n - sums
        out[i] = n, int((d * d).sum()), (d / n).astype(float) @ to, values[::-1][:k] / values.sum()
    return out


def check_whitening(out, want, k, tolerance=1e-9):
    rows = out.collect()
    assert len(rows) == k * len(want)
    signs = {}
    for r in sorted(rows, key=lambda r: (r.component, r.vec_id)):
        n, deviation, w, explained = want[r.vec_id]
        c = r.component - 1
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, explained[c], rel_tol=1e-9) and r.identity_error < 1e-9
        if c not in signs and abs(w[c]) > 0.1:
            signs[c] = np.sign(w[c]) * np.sign(r.whitened)
        assert abs(r.whitened - signs.get(c, 1) * w[c]) < (tolerance if c in signs else 0.2)


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dims)) * np.linspace(1.5, 0.2, dims)).astype(np.float32).tolist()


@pytest.mark.parametrize("dims", [2, 5, 40])
def test_whitening(spark, dims):
    v = vectors(200, dims)
    rows = list(enumerate(v)) + [(500 + i, v[0]) for i in range(60)] + [(900, None), (901, v[0][:-1] + [None]), (902, v[0][:-1] + [float("nan")]), (903, [float("-inf")] * dims), (904, [-0.0] * dims)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, x string, n int").repartition(3)
    check_whitening(whitening.whiten(df), brute_whitening(rows, min(4, dims)), min(4, dims))


def test_whitening_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check_whitening(whitening.whiten(df), brute_whitening([(r.vec_id, r.embedding) for r in df.collect()], 4), 4, 1e-8)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = [(1, [1.0, 2.0, 0.0]), (None, [2.0, 4.0, 0.0]), (3, [4.0, 8.0, 0.0]), (4, [1.0])]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert sorted(((r.vec_id, r.component) for r in got), key=str) == [(1, 1), (3, 1), (None, 1)] and abs(got[0].explained - 1) < 1e-12
    huge = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])]
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(spark.createDataFrame(huge, schema)).collect()} >= {(1, None), (2, None)}


def test_lanczos_restarts_and_breaks_down():
    rng = np.random.default_rng(2)
    for dims, values in ((30, np.r_[[9.0, 9, 9, 4], np.zeros(26)]), (300, np.linspace(5, 0.1, 300)), (400, np.r_[[7.0] * 6, np.full(394, 1.0)]), (3, np.ones(3))):
        q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        a = q * values @ q.T
        found, vectors_, residuals = whitening.block_lanczos(lambda b: a @ b, dims, 4, block=6, keep=8)
        k = min(4, dims)
        assert np.allclose(found, np.sort(values)[::-1][:k], rtol=1e-10, atol=1e-10) and residuals.max() < 1e-9
        assert np.allclose(vectors_.T @ vectors_, np.eye(k), atol=1e-10)


def test_a_shard_is_laid_out_in_little_memory():
    """A worker's arrays stay a small multiple of the shard, also where every word and pair may be frequent."""
    rng = np.random.default_rng(7)
    data = np.frombuffer(b" ".join(b"w%d" % w for w in rng.zipf(1.3, 300_000) % 20_000), dtype=np.uint8)
    tracemalloc.start()
    try:
        shard = phrase_bitmaps.Shard("en", data)
        for _ in phrase_bitmaps.mine(shard, np.ones(len(shard.vocab), dtype=bool), lambda a, b: np.ones(len(b), dtype=bool), 4):
            pass
        assert tracemalloc.get_traced_memory()[1] < 60 * len(data)
    finally:
        tracemalloc.stop()


def test_prefixes_meet_only_words_that_follow(monkeypatch):
    """Not all words of a block of positions: what a step holds at once is as long as the text, not a block's words times that."""
    monkeypatch.setattr(phrase_bitmaps, "TOGETHER", 1 << 30)
    n = 200_000
    shard = phrase_bitmaps.Shard("en", np.frombuffer(b" ".join(b"w%d" % w for w in np.random.default_rng(5).integers(0, 5_000, n)), dtype=np.uint8))
    tracemalloc.start()
    try:
        assert sum(int(c.sum()) for _, c in phrase_bitmaps.mine(shard, np.ones(len(shard.vocab), dtype=bool), lambda a, b: np.ones(len(b), dtype=bool), 2)) == n - 1
        assert tracemalloc.get_traced_memory()[1] < 150 * n
    finally:
        tracemalloc.stop()


def test_rare_runs_are_not_spelt_out(spark, monkeypatch):
    """All pairs are frequent here and most runs of three are rare: these are ruled out by their hash."""
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choices("abcdefgh", k=40)) + ".") for _ in range(200)]
    made = spark.sparkContext.accumulator(0)
    batches = phrase_bitmaps._batches

    def counted(lang, columns, names, rows=1 << 16):
        if "phrase" in names:
            made.add(len(columns[0]))
        return batches(lang, columns, names, rows)

    monkeypatch.setattr(phrase_bitmaps, "_batches", counted)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    words = phrase_bitmaps.word_counts(docs)
    found = phrase_bitmaps.phrase_counts(docs, phrase_bitmaps.filter_of(words.where("word IS NOT NULL").select("h")), 4, 20).collect()
    exact = Counter()
    for _, text in rows:
        w = text[:-1].split(" ")
        exact.update(tuple(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert {tuple(r.phrase.split(" ")): r.a for r in found} == {p: a for p, a in exact.items() if a >= 20}
    assert made.value < sum(a >= 20 for a in exact.values()) * 1.5 + sum(len(p) == 4 for p in exact) // 2


def test_phrases_are_spelt_out_once(spark, monkeypatch):
    """Shards hand on hashes and counts; the words of a phrase come from the vocabulary, once for all shards that hold it."""
    docs = spark.createDataFrame([("en", "the cat sat on the mat. " * 5)] * 40, "lang string, text string").repartition(4)
    schemas = []
    over = phrase_bitmaps._over_shards
    monkeypatch.setattr(phrase_bitmaps, "_over_shards", lambda docs, fn, schema, *rest: schemas.append(schema) or over(docs, fn, schema, *rest))
    words, apart = phrase_bitmaps.vocabulary(docs, 30)
    known = phrase_bitmaps.filter_of(words.where("word IS NOT NULL").select("h"))
    found = phrase_bitmaps.phrase_counts(docs, known, 4, 30, known=(words, apart))
    assert {(r.lang, r.phrase, r.k, r.a) for r in found.collect()} == {("en", p, len(p.split()), 200) for p in ("the cat", "cat sat", "sat on", "on the", "the mat", "the cat sat", "cat sat on", "sat on the", "on the mat", "the cat sat on", "cat sat on the", "sat on the mat")}
    assert apart == [] and len(schemas) == 4 and not any("string" in s for s in schemas[1:])


def test_words_of_one_hash_are_told_apart(spark):
    """Two words on which every polynomial hash modulo 2 ** 64 agrees get others, so their phrases are counted apart."""
    u = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    v = u.translate(str.maketrans("ab", "ba"))
    both = phrase_bitmaps.Shard("en", np.frombuffer(f"{u} {v}".encode(), dtype=np.uint8))
    assert both.hash[0] == both.hash[1]
    rows = [("en", f"{w} and so on") for w in (u, v, v) for _ in range(4)] + [("de", f"und {u}")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    _, apart = phrase_bitmaps.vocabulary(docs, 5)
    assert [len(x) for x in apart] == [1]
    for least in (5, 12):
        assert sorted(map(tuple, phrase_bitmaps.collocations(docs, least=least, top=12).collect())) == brute_phrases(rows, 4, least, 12)


def test_words_that_are_languages_have_hashes_of_their_own():
    h = [phrase_bitmaps.Shard(lang, np.frombuffer(word.encode(), dtype=np.uint8)).hash[0] for lang in ("de", "en", "es") for word in ("de", "en", "es")]
    assert len(set(h)) == 9
