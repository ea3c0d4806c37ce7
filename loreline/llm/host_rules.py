"""Quality rules at the level of hosts: rule failures are summed by domain, shrunk by an empirical beta prior, and judged for all of its documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import hot_lookup, joined_bytes, pieces_of, text_of, tidy, written

#: Bytes of text that are measured together.
PIECE = 4 << 20
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A domain goes where the lower posterior bound (mean less Z deviations) of the share of its documents that fail a rule is over MAX_RATE.
MAX_RATE, Z = 0.5, 1.645

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _numbered(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of data that inside marks: a number (equal bytes, equal number), start and end of each."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())])
    return _coded(found), start, end


def _coded(values: pa.Array | np.ndarray) -> np.ndarray:
    """A number for each value, the same for equal ones."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    code = _coded(key)
    first = np.zeros(len(code), dtype=bool)
    first[np.unique(code, return_index=True)[1]] = True
    return np.bincount(code)[code] > 1 if len(code) else first, ~first


def measured(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (null: no words). Everything is told by its bytes, no hash."""
    data, offsets = joined_bytes(texts)
    n = len(offsets) - 1
    # a line end behind each text, so that no word or line goes on into the next
    wide = np.full(len(data) + n, 10, dtype=np.uint8)
    wide[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    begin = offsets[:-1] + np.arange(n)
    inside = ~_GAP[wide]
    word, start, _ = _numbered(wide, inside)
    doc = np.searchsorted(begin, start, side="right") - 1
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.append(begin, len(wide))])

    line, first, last = _numbered(wide, wide != 10)
    told = np.concatenate([[0], np.cumsum(inside)])
    full = told[last] > told[first]
    of_line = np.searchsorted(begin, first[full], side="right") - 1
    _, copy = _again(line[full] * n + of_line)

    repeated = np.zeros(len(word), dtype=np.int64)
    if len(word) >= WINDOW:
        gram = word
        for k in range(1, WINDOW):
            gram = _coded(gram[:-1] << 32 | word[k:])
        whole = np.flatnonzero(doc[: len(gram)] == doc[WINDOW - 1 :])
        twice, _ = _again(gram[whole] << 32 | doc[whole])
        at = whole[twice]
        cover = np.zeros(len(word) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        repeated = np.cumsum(cover)[:-1] > 0
    count = lambda of, weights=None: np.bincount(of, weights=weights, minlength=n).astype(np.int64)
    return [count(doc), sums(inside & ((wide & 0xC0) != 0x80)), sums(_SYMBOL[wide]), count(of_line, copy), count(doc, repeated)]


def features(docs: DataFrame, domain: str) -> DataFrame:
    """doc_id, domain and the five counts of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 2, PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x) for x in measured(part.column(2))]], names=["doc_id", "domain", *_COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), text_of().alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, domain string, " + ", ".join(f"{c} long" for c in _COUNTS))


def failures() -> dict[str, Column]:
    """The rules that domains are judged by; each is whether a document fails."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 12),
        "symbols": F.col("n_symbols") * 10 > n,
        "dup_lines": F.col("n_dup_lines") * 10 > n,
    }


def prior(rates: DataFrame, name: str) -> tuple[float, float]:
    """Mean and strength of the beta prior that domains (n, and the failures in the column name) give, by moments of the beta-binomial.

    One row of sums comes to the driver. Without two domains, or a spread beyond chance, domains count as alike and the
    strength is the largest allowed, 1000; it is never under 1.
    """
    k = F.col(name)
    s = rates.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(k).alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(k.cast("double") * k / F.col("n")).alias("y2")).first()
    if not s.n:
        return 0.0, 1000.0
    p = s.k / s.n
    between = s.y2 - s.n * p * p - p * (1 - p) * (s.m - 1)
    most = p * (1 - p) * (s.n - s.n2 / s.n - (s.m - 1))
    return p, 1000.0 if most <= 1e-9 else 1 / min(max(between / most, 1 / 1001), 0.5) - 1


def domain_verdicts(rows: DataFrame, max_rate: float = MAX_RATE, z: float = Z) -> DataFrame:
    """One row a domain of rows (domain and counts of documents): domain, n, a column rate_<rule> with the shrunk share of
    documents that fail each rule, worst (the largest lower bound among them) and rejected."""
    rules = failures()
    sums = rows.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()])
    rates, bounds = {}, []
    for r in rules:
        p, strength = prior(sums, r)
        total = F.col("n") + strength
        rates[f"rate_{r}"] = (F.col(r) + strength * p) / total
        bounds.append(F.col(f"rate_{r}") - z * F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (total + 1)))
    return sums.withColumns(rates).withColumn("worst", F.greatest(*bounds)).select("domain", "n", *rates, "worst", (F.col("worst") > max_rate).alias("rejected"))


def judge(docs: DataFrame, domain: str = "source", max_rate: float = MAX_RATE, z: float = Z) -> DataFrame:
    """Judges every row of docs (doc_id, text and the column domain; others are ignored) by rules on its text and on its domain.

    Words are runs without spaces, tabs and line ends (09 to 0D). Returns doc_id, n_words, word_chars (their code
    points), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in
    windows of five words that the text holds twice or more), base_failed (under 10 words, or over 20 % of them
    repeated), kept, and domain_rejected. A document is kept if it passes the base rules and its domain is not rejected, see domain_verdicts.

    Null texts have no words. Documents of a null domain are judged by the base rules alone. Every row is judged by
    itself, so null and repeated ids are rows like others. No documents give no rows.
    """
    rows = written(features(docs, domain), "rule-counts")
    verdicts = domain_verdicts(rows, max_rate, z).select(F.concat(F.lit("d"), "domain").alias("key"), "n", "rejected")
    named = rows.withColumn("key", F.coalesce(F.concat(F.lit("d"), "domain"), F.lit("")))
    out = hot_lookup(named, verdicts, "key", "n", rows.count())
    fails = failures()
    base = fails["few_words"] | fails["repeats"]
    rejected = F.coalesce("rejected", F.lit(False))
    return out.select("doc_id", *_COUNTS, base.alias("base_failed"), (~base & ~rejected).alias("kept"), rejected.alias("domain_rejected"))
