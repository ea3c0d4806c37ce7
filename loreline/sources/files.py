"""Manuscripts, annotation documents, token tables and proposals as DataFrames, and writers for them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of annotation documents, read without inference.
SPAN = "start INT, end INT"
DOCUMENT = (
    f"story_id STRING, text STRING, mentions ARRAY<STRUCT<mention_id: STRING, text: STRING, type: STRING, mention_kind: STRING, start: INT, end: INT>>, "
    "coreference_clusters ARRAY<STRUCT<cluster_id: STRING, mentions: ARRAY<STRING>>>, "
    "events ARRAY<STRUCT<event_id: STRING, type: STRING, trigger: STRING, start: INT, end: INT, participants: ARRAY<STRUCT<role: STRING, mention_id: STRING>>>>, "
    "relationships ARRAY<STRUCT<relationship_id: STRING, predicate: STRING, subject_mention_id: STRING, object_mention_id: STRING>>, "
    "facts ARRAY<STRUCT<fact_id: STRING, property: STRING, entity_mention_id: STRING, value: STRING>>, _corrupt_record STRING"
)


class UnsupportedFormat(ValueError):
    """A file kind that no installed library can read."""


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each file, UTF-8 with bad bytes replaced."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("file"), F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"))


def _paragraphs(content: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    kinds = {f"{space}t": lambda e: e.text or "", f"{space}tab": lambda e: "\t", f"{space}br": lambda e: "\n"}
    return "\n".join("".join(kinds[e.tag](e) for e in p.iter() if e.tag in kinds) for p in body.iter(f"{space}p"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each .docx: its paragraphs, a line each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file": f["path"], "text": [_paragraphs(bytes(c)) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, text string")


def read_manuscripts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "txt":
        return read_text(spark, path)
    if kind == "docx":
        return read_docx(spark, path)
    raise UnsupportedFormat(kind)


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Annotation documents of a folder and those below; a broken file is a row with _corrupt_record."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)


def read_tokens(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header and no quoting."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def read_lists(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """A CSV with a header; the columns in lists hold lists as ['a', 'b'] or nothing (also 'nan') and become arrays."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    for c in lists:
        text = F.regexp_replace(F.col(c), r"'((?:[^'\\]|\\.)*)'", '"$1"')
        rows = rows.withColumn(c, F.coalesce(F.from_json(F.when(~F.lower(F.trim(c)).isin("", "nan"), text), "array<string>"), F.array().cast("array<string>")))
    return rows


def with_predictions(gold: DataFrame, pred: DataFrame, key: str = "story_id") -> DataFrame:
    """gold and pred as structs side by side; a missing prediction is an empty one: its lists are empty, all else is null."""
    p = pred.select(F.col(key), F.struct(*pred.columns).alias("pred"))
    lists = [F.array().cast(f.dataType).alias(f.name) if f.dataType.typeName() == "array" else F.lit(None).cast(f.dataType).alias(f.name) for f in pred.schema]
    both = gold.select(F.col(key), F.struct(*gold.columns).alias("gold")).join(p, key, "left")
    return both.withColumn("pred", F.coalesce("pred", F.struct(*lists)))


def overlay(documents: DataFrame, fixes: DataFrame, columns: list[str], key: str = "story_id") -> DataFrame:
    """documents with the columns of fixes in place of their own where a fix gives them."""
    f = fixes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return documents.join(f, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def write_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_job(spark: SparkSession, path: str, job_id: str, schema: str) -> DataFrame:
    """Proposals of one job; none stored gives no rows."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("job_id") == job_id)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def missing_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests with their key, the SHA-256 of their canonical JSON, that the cache (key) does not hold."""
    keyed = requests.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(requests.columns))), 256))
    return keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def stored_requests(requests: DataFrame, cache: DataFrame, path: str) -> None:
    """Appends answered requests (with key, answer and what was measured) that the cache does not hold to its table."""
    requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).write.mode("append").parquet(path)


def safe_name(name: Column, salt: Column) -> Column:
    """A stored file's name: 32 digits that follow from salt and name, then the last part of the name alone."""
    return F.concat_ws("_", F.substring(F.sha2(F.concat_ws("\u0001", salt, name), 256), 1, 32), F.regexp_extract(name, r"[^/\\\\]*$", 0))


def write_contents(files: DataFrame, path: str) -> None:
    """files (name, salt, content) as a table partitioned by safe name, a file's rows replaced if it is written again."""
    write_partitioned(files.select(safe_name(F.col("name"), F.col("salt")).alias("stored"), "name", "content"), path, "stored")


def stored_text(stored: DataFrame, name: str) -> str:
    """The text of one stored file; an unknown name is an error."""
    found = stored.where(F.col("stored") == name).select("content").first()
    if found is None:
        raise FileNotFoundError(name)
    return found.content


def delete_stored(spark: SparkSession, path: str, name: str) -> bool:
    """Deletes one stored file's partition; whether there was one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/stored={name}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_reviewed(documents: DataFrame, issues: DataFrame, path: str, key: str = "story_id") -> None:
    """documents as JSON, and issues (key, issue) as text, a folder a document that has some."""
    documents.write.mode("overwrite").json(f"{path}/documents")
    issues.select(key, F.col("issue").alias("value")).write.mode("overwrite").partitionBy(key).text(f"{path}/issues")


def save_profiles(profiles: DataFrame, changes: DataFrame, path: str) -> None:
    """profiles (user_id, display_name, preferences map) after changes of the same columns: what is not null replaces what was,
    key by key. Written as a new table for the caller to swap in."""
    new = changes.select("user_id", F.col("display_name").alias("n"), F.col("preferences").alias("p"))
    both = profiles.join(new, "user_id", "full")
    kept = F.map_filter(F.coalesce("preferences", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("p", k), F.lit(False)))
    merged = F.map_concat(kept, F.coalesce("p", F.create_map().cast("map<string,string>")))
    both.select("user_id", F.coalesce(F.substring(F.trim("n"), 1, 120), "display_name").alias("display_name"), merged.alias("preferences")).write.mode("overwrite").parquet(path)
