"""Quality classifier: importance resampling with hashed n-gram models of target and raw text, by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from loreline.llm.common import joined_bytes, mix, packed, run_hashes, unpacked, written

#: Hash buckets of words and word pairs, and the strength of the raw model as prior of the target's, in raw counts a bucket.
BUCKETS, PRIOR = 1 << 16, 30.0

#: Labelled rows used at most to fit the target model, and as many others to place the cut. Raw counts use every row.
FIT_ROWS = 100_000

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[128:] = 1
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's words and pairs of neighbouring words, and the number of the text of each.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, or of other printable bytes; case stands.
    """
    data, at = joined_bytes(texts)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data))
    words = kind[starts] != 0
    starts, ends = starts[words], ends[words]
    h = run_hashes(data, starts, ends)
    own = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
    together = own[1:] == own[:-1]
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[together]
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([own, own[:-1][together]])


@dataclass(frozen=True)
class Model:
    """Counts of each bucket in all documents (raw) and in the target sample, which holds the documents in fitted."""

    raw: np.ndarray
    target: np.ndarray
    fitted: DataFrame
    prior: float = PRIOR

    def log_weights(self, texts: pa.Array, fitted: np.ndarray) -> np.ndarray:
        """Sum over a text's features of log target probability over raw probability, both without the text itself.

        Leaving a text out puts those that were counted for the target and those that were not on the same footing.
        The target's probabilities are drawn towards the raw ones, so features without evidence weigh nothing.
        """
        buckets = len(self.raw)
        share = max(self.target.sum(), 1) / max(self.raw.sum(), 1)
        total = np.zeros(len(texts))
        for at in range(0, len(texts), 500):
            part = texts.slice(at, 500)
            bucket, own = features(part, buckets)
            both, n = np.unique(own * buckets + bucket, return_counts=True)
            own, bucket = both // buckets, both % buckets
            mine = n * fitted[at : at + len(part)][own]
            ratio = (self.target[bucket] - mine + self.prior * share) / ((self.raw[bucket] - n + self.prior) * share)
            total[at : at + len(part)] = np.bincount(own, weights=np.log(ratio) * n, minlength=len(part))
        return total


def fit(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> Model:
    """Counts the features of all documents (raw) and of those in targets (doc_id, at most FIT_ROWS rows).

    Every task sums its own documents; one row a bucket comes to the driver.
    """
    targets = targets.select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bucket, own = features(part.column(0), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                chosen = np.array(part.column(1).to_pylist(), dtype=bool)
                target += np.bincount(bucket[chosen[own]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(F.broadcast(targets.withColumn("chosen", F.lit(True))), "doc_id", "left")
    counts = marked.select("text", F.coalesce("chosen", F.lit(False)).alias("chosen")).mapInArrow(run, "bucket long, raw long, target long")
    found = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found.bucket.to_numpy(np.int64)], target[found.bucket.to_numpy(np.int64)] = found.raw, found.target
    return Model(raw, target, targets, prior)


def weigh(rows: DataFrame, model: Model) -> DataFrame:
    """rows (doc_id, text, rest: of packed) with log_weight: the sum of the model's log ratios over a text's features; null
    and empty texts have 0."""
    held = rows.sparkSession.sparkContext.broadcast((model.raw, model.target, model.prior))
    names = ["doc_id", "text", "rest", "log_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Model(*held.value[:2], None, held.value[2])
        for batch in batches:
            fitted = batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts.log_weights(batch.column(1), fitted))], names=names)

    marked = rows.join(F.broadcast(model.fitted.withColumn("fitted", F.lit(True))), "doc_id", "left")
    marked = marked.select("doc_id", "text", "rest", F.coalesce("fitted", F.lit(False)).alias("fitted"))
    types = (LongType(), StringType(), rows.schema["rest"].dataType, DoubleType())
    return marked.mapInArrow(run, StructType([StructField(n, t) for n, t in zip(names, types, strict=True)]))


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the id and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value (1 <= k <= rows) of a numeric column without nulls, exact, by counts over ever finer bins.

    At most bins rows come to the driver in a round.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            values = rows.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).limit(bins).collect()
            for v in values:
                if k <= v["count"]:
                    return v[column]
                k -= v["count"]
            raise ValueError("too many values within one rounding step")
        inside = rows.where(F.col(column).between(low, high))
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for c in counts:
            if k <= c.n:
                low, high = c.low, c.high
                break
            k -= c.n
    return low


def among_top_k(weighed: DataFrame, k: int) -> Column:
    """Whether a row of weighed (doc_id, key) is among the k rows of the largest key, as a condition on these columns.

    Rows that share the k-th key stand in the order of doc_id until k are reached; rows that share both are all
    selected. k of 0 or less selects none, k beyond the rows all.
    """
    n = weighed.count()
    if k <= 0 or k >= n:
        return F.lit(k > 0)
    order = -F.coalesce("doc_id", F.lit(0))
    cut = kth_largest(weighed, "key", k)
    tied = weighed.where(F.col("key") == cut).select(order.alias("order"))
    room = k - weighed.where(F.col("key") > cut).count()
    return (F.col("key") > cut) | ((F.col("key") == cut) & (order >= kth_largest(tied, "order", room)))


def gumbel_top_k(weighed: DataFrame, k: int) -> DataFrame:
    """weighed (doc_id, key) with selected, by among_top_k."""
    return weighed.withColumn("selected", among_top_k(weighed, k))


@dataclass(frozen=True)
class Classifier:
    """A fitted model and the least key of a document that passes."""

    model: Model
    cut: float
    seed: int

    def judge(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, rest (of packed), log_weight and key."""
        return weigh(packed(docs), self.model).withColumn("key", F.col("log_weight") + gumbel_noise(F.col("doc_id"), self.seed))


def train(docs: DataFrame, labels: DataFrame, lost: float = 0.005, seed: int = 17, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fits on half of the labelled targets and places the cut on the other half.

    labels: doc_id, target (boolean; a document whose repeated labels differ is no target). A hash of doc_id decides the
    half and which rows a sample of more than fit_rows keeps. The cut is the lost quantile of the other half's keys:
    that share of target documents is expected to fall under it. Without labelled targets everything passes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    targets = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("target").cast("int")).alias("target")).where("target = 1 AND doc_id IS NOT NULL")
    drawn = targets.select("doc_id", F.xxhash64("doc_id", F.lit(seed + 1)).alias("draw"))
    halves = [drawn.where(F.pmod("draw", F.lit(2)) == i).orderBy("draw", "doc_id").limit(fit_rows).select("doc_id") for i in (0, 1)]
    model = fit(docs, written(halves[0], "fitted"))
    keys = Classifier(model, 0.0, seed).judge(docs.join(F.broadcast(halves[1]), "doc_id", "left_semi"))
    cut = keys.agg(F.percentile("key", F.lit(lost))).first()[0]
    return Classifier(model, float("-inf") if cut is None else cut, seed)


def draw(docs: DataFrame, labels: DataFrame, k: int | None, lost: float, seed: int) -> tuple[Classifier, DataFrame, Column]:
    """The trained classifier, a table of doc_id, log_weight and key of all docs, and the condition of among_top_k. With k
    None as many are drawn as documents that look like targets: those whose key reaches the classifier's cut."""
    classifier = train(docs, labels, lost, seed)
    keys = written(classifier.judge(docs.select("doc_id", "text")).select("doc_id", "log_weight", "key"), "keys")
    return classifier, keys, among_top_k(keys, keys.where(F.col("key") >= classifier.cut).count() if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, lost: float = 0.005, seed: int = 17) -> DataFrame:
    """Importance resampling of all documents (doc_id, text; other columns are ignored) towards the labelled targets.

    Returns for every row doc_id, log_weight, key (log weight plus Gumbel noise of the id) and selected: whether it is
    among the k largest keys, a draw without replacement in proportion to the importance weights. Without k, it is
    the number of documents that look like targets: all but a share of lost of held-out targets are expected among
    them. Weights are sums over a whole text, so next to those of long texts the noise is small. Null and empty texts
    have log_weight 0; repeated rows of an id share their noise; no documents give no rows.
    """
    _, keys, chosen = draw(docs, labels, k, lost, seed)
    return keys.withColumn("selected", chosen)


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None, lost: float = 0.005, seed: int = 17) -> DataFrame:
    """The rows that resample selects, all columns as they were. Every row is judged by its own text, once to draw and once
    more as it passes, so that no table of whole documents is kept."""
    classifier, _, chosen = draw(docs, labels, k, lost, seed)
    return unpacked(classifier.judge(docs).where(chosen), docs.columns)
