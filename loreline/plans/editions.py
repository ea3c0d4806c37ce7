"""Queries over documents as an edition, and over what a corpus would have written of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.operators import restore
from loreline.sources.worlds import World


def edition(w: World) -> DataFrame:
    return w.raw("documents").select(F.col("doc_id").alias("doc"), "text")


def corpus(w: World) -> DataFrame:
    """Documents as a corpus writes them; lines with an accent before a word that begins with a are damaged for good."""
    return edition(w).select("doc", restore.corpus_form(F.regexp_replace("text", "é a", "? a"), "bytes").alias("text"))


def restored(w: World) -> DataFrame:
    out = restore.restored(restore.matched_lines(corpus(w), edition(w), "bytes"), "bytes")
    return out.select("doc", F.sha2("text", 256).alias("sha"), "restored", F.size("unmatched").alias("unmatched"))


def moved(w: World) -> DataFrame:
    """Where the lines of the corpus went."""
    lines = restore.matched_lines(corpus(w), edition(w), "bytes")
    upto = F.sum(F.length("line") + 1).over(restore.W.partitionBy("doc").orderBy("n")) - F.length("line") - 1
    spans = lines.select("doc", F.col("n").alias("id"), upto.alias("start"), (upto + F.length("line")).alias("end"))
    return restore.moved(spans, restore.pieces(lines, "bytes")).groupBy("doc").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


_FORM = "regexp_replace(regexp_replace(regexp_replace(translate({0}, '“”’', '\"\"'''), '[\\x{{80}}-\\x{{7FF}}]', '  ', 'g'), '[\\x{{800}}-\\x{{FFFF}}]', '   ', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '    ', 'g')"
_LINES = f"""
    WITH e AS (SELECT doc_id AS doc, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents
    ), k AS (SELECT doc, {_FORM.format('line')} AS form, min(line) AS original FROM e GROUP BY ALL HAVING count(DISTINCT line) = 1
    ), c AS (SELECT doc, unnest(x) AS line, unnest(range(len(x))) AS n FROM (SELECT doc_id AS doc, string_split({_FORM.format("replace(text, 'é a', '? a')")}, chr(10)) AS x FROM documents)
    ), l AS (SELECT c.doc, c.n, c.line, original, coalesce(translate(original, '“”‘’', '""' || repeat(chr(39), 2)), line) AS done FROM c LEFT JOIN k ON k.doc = c.doc AND k.form = c.line)"""

QUERIES = {
    "restored_texts": (restored, _LINES + """
        SELECT doc, sha256(string_agg(done, chr(10) ORDER BY n)) AS sha, sum(coalesce(length(regexp_replace(translate(original, '“”’', ''), '[\\x00-\\x7F]', '', 'g')), 0)) AS restored,
               count(*) FILTER (original IS NULL AND trim(line) <> '') AS unmatched FROM l GROUP BY doc"""),
    "moved_lines": (moved, _LINES + """
        SELECT doc, count(*) AS n, sum(place)::BIGINT AS starts, sum(place + length(done))::BIGINT AS ends FROM (SELECT *, coalesce(sum(length(done) + 1) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM l) GROUP BY doc"""),
}
