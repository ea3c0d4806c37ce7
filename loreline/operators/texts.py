"""Text operators: a chapter to its paragraphs, sentences, chunks and chapters, with exact offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loreline.functions import prose


#: Bytes that a task reads by itself; a smaller table may come as fewer splits than there are cores.
SPLIT_BYTES = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many partitions as the cluster runs tasks, where the plan's estimate is under a full split for each:
    work on a text is more than moving it, and a small file of one row group would be one task."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(tasks) if size < tasks * SPLIT_BYTES else rows


def _rows(chapters: DataFrame, key: str, text: str, schema: str, fn: Callable[[str], list[tuple]]) -> DataFrame:
    """key and a row for each tuple that fn makes of the text, in Arrow batches of a few thousand rows."""
    full = f"{key} {dict(chapters.dtypes)[key]}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(k, *row) for row in fn(t or "")]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return spread(chapters.select(key, text)).mapInArrow(run, full)


def paragraphs(chapters: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(chapters, key, text, "paragraph int, start int, end int", lambda t: [(i, a, b) for i, (a, b) in enumerate(prose.paragraphs(t))])


def sentences(chapters: DataFrame, key: str, text: str) -> DataFrame:
    """One row a sentence: paragraph, p_start, p_end, sentence, start, end, text. Texts without words give no rows."""
    schema = "paragraph int, p_start int, p_end int, sentence int, start int, end int, text string"
    return _rows(chapters, key, text, schema, lambda t: [(*r, t[r[4] : r[5]]) for r in prose.document(t)])


def chunks(chapters: DataFrame, key: str, text: str, most: int = 8000, overlap: int = 2) -> DataFrame:
    """One row a chunk: chunk, sentence_ids, overlap_ids, start, end, text."""

    def one(t: str) -> list[tuple]:
        spans = [r[4:] for r in prose.document(t)]
        ids = [f"s{i:04d}" for i in range(len(spans))]
        return [(n, ids[a:c], ids[a:b], spans[a][0], spans[c - 1][1], t[spans[a][0] : spans[c - 1][1]]) for n, (a, b, c) in enumerate(prose.chunks(spans, most, overlap))]

    return _rows(chapters, key, text, "chunk int, sentence_ids array<string>, overlap_ids array<string>, start int, end int, text string", one)


def new_sentences(sentence_ids: Column, overlap_ids: Column) -> Column:
    return F.slice(sentence_ids, F.size(overlap_ids) + 1, F.size(sentence_ids))


def split_chapters(manuscripts: DataFrame, key: str, text: str) -> DataFrame:
    """chapter_number, title, content of each manuscript."""
    return _rows(manuscripts, key, text, "chapter_number int, title string, content string", prose.chapters)


def novel_chapters(novels: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(novels, key, text, "chapter_number int, start int, end int", lambda t: [(i, *s) for i, s in enumerate(prose.novel_chapters(t), 1)])


def broken_spans(found: DataFrame, chapters: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences whose text is not what their offsets cut, or that start before the last one ends: none, if all is well.
    A chapter meets its sentences once, as a list; a row a sentence would carry the chapter's text as often as it has sentences."""
    rest = [c for c in found.columns if c not in (key, "sentence")]
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence", *rest))).alias("_s"))

    def broken(x: Column, i: Column) -> Column:
        cut = F.substring("_all", x["start"] + 1, x["end"] - x["start"])
        return (cut != x["text"]) | (F.get("_s", i - 1)["end"] > x["start"])

    rows = lists.join(chapters.select(key, F.col(text).alias("_all")), key).select(key, F.explode(F.filter("_s", broken)).alias("_x"))
    return rows.select(*[F.col(key) if c == key else F.col(f"_x.{c}").alias(c) for c in found.columns])


def locate(chapters: DataFrame, key: str, text: str, values: str, names: str) -> DataFrame:
    """key, sentence, line, start, end of the sentence that best shows the values (array column) near the names."""
    schema = "sentence int, line int, start int, end int"
    full = f"{key} {dict(chapters.dtypes)[key]}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, v, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                spans = [r[4:] for r in prose.document(t or "")]
                at = prose.locate(spans, t or "", v or [], n or [])
                if at is not None:
                    out.append((k, at, t.count("\n", 0, spans[at][0]) + 1, *spans[at]))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return chapters.select(key, text, values, names).mapInArrow(run, full)
