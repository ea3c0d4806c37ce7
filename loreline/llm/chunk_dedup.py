"""Exact dedup by content-defined chunk recipes. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import hot_lookup, packed, text_of, unpacked, written

#: Characters of a chunk, least and most. A chunk ends at the first sentence or line end after the least.
MIN_CHARS, MAX_CHARS = 256, 2048


def chunks_of(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Cuts a text where its own content says so. The chunks in order make up the text; an empty text has none."""
    pattern = rf"(?s).{{{least},{most - 1}}}?[.!?\n。]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashing_keys(chunks: DataFrame) -> DataFrame:
    """Chunk keys that stand for more than one chunk: each distinct chunk (columns key, chunk) crosses one shuffle,
    after the copies in a task have become one, and is compared there byte for byte."""
    return chunks.groupBy("key", "chunk").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def chunk_id(key: Column) -> Column:
    """A chunk key as 16 hexadecimal digits, so that lists of them read one way only."""
    return F.lpad(F.hex(key), 16, "0")


def chunk_recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered list of the text's chunk identifiers.

    A chunk is known by a 64-bit hash. Wherever the comparison of all chunks finds a hash that two chunks share, the
    documents that hold it list the SHA-256 of their chunks instead, so equal lists always mean equal texts.
    """
    texts = docs.select("doc_id", F.sha2(text_of().cast("binary"), 256).alias("text_sha256"), chunks_of(text_of()).alias("chunks"))
    base = texts.select("doc_id", "text_sha256", F.transform("chunks", lambda c: chunk_id(F.xxhash64(c))).alias("recipe"))
    clash = clashing_keys(docs.select(F.explode(chunks_of(text_of())).alias("chunk")).select(F.xxhash64("chunk").alias("key"), "chunk"))
    clash = written(clash, "clash")
    if clash.isEmpty():
        return base
    held = base.select("text_sha256", F.explode("recipe").alias("key")).join(clash.select(chunk_id(F.col("key")).alias("key")), "key", "left_semi")
    strong = (
        texts.join(held.select("text_sha256").distinct(), "text_sha256", "left_semi")
        .select("text_sha256", F.transform("chunks", lambda c: F.concat(F.lit("s"), F.sha2(c.cast("binary"), 256))).alias("strong")).distinct()
    )
    return base.join(strong, "text_sha256", "left").select("doc_id", "text_sha256", F.coalesce("strong", "recipe").alias("recipe"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups documents (doc_id, text; further columns are ignored) whose texts are identical; null counts as empty.

    Returns a row for each input row: doc_id, keep_id (largest doc_id of the group), group_size, kept, text_sha256,
    n_chunks. Rows that repeat a doc_id with the same text are all kept or all dropped; a null doc_id is kept only in a
    group of null doc_ids. No documents: no rows. Nothing but each distinct chunk and the lists crosses the network; the group
    of a text that fills much of the table is summed before the shuffle and looked up by broadcast, where lists of more
    than 4,000 characters stand as their SHA-256.
    """
    whole = F.concat_ws(",", "recipe")
    recipes = chunk_recipes(docs).withColumn("key", F.when(F.length(whole) > 4000, F.sha2(whole.cast("binary"), 256)).otherwise(whole))
    groups = recipes.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = hot_lookup(recipes, groups, "key", "group_size", docs.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each text, with all its columns: that of the largest doc_id, null only where all are. Every row is judged
    by its own text; of rows that repeat both doc_id and text one stays."""
    rows = packed(docs).withColumn("sha", F.sha2(text_of().cast("binary"), 256))
    judged = written(exact_dedup(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("id"), F.col("text_sha256").alias("of"), "kept"), "judged")
    dropped = judged.where("not kept").select("id", "of").distinct()
    kept = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left_anti")
    if not judged.where("kept").groupBy("of").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["sha"])
    return unpacked(kept, docs.columns)
