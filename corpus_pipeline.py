"""Corpus pipeline: from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreline.llm import chunk_dedup, curve_packing, importance_resampling, minhash_forest, suffix_dedup
from loreline.llm.common import bound_batches, table, written
from loreline.llm.queries import target_labels
from loreline.llm.tokenizer_files import public_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling towards the labelled targets rejects."""
    bound_batches(spark)
    return importance_resampling.keep_selected(docs, target_labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    bound_batches(spark)
    return chunk_dedup.drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, likeness 0.8) the one with the smallest doc_id stays."""
    bound_batches(spark)
    return minhash_forest.keep_one_a_class(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte of a passage of 100 bytes that also starts earlier; documents stay, if with an empty text."""
    bound_batches(spark)
    return suffix_dedup.cut_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents along a space-filling curve into sequences of at most 2048 ids."""
    bound_batches(spark)
    return curve_packing.pack(docs, public_path("byte_bpe_50k.json"))


#: In order; all but the last return the columns of documents.
STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_passages),
    ("packing", pack_sequences),
]

#: Hashed models, suffix order and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
