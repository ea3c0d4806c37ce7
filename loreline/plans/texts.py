"""Segmentation, chapters and text scalars over the documents as chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreline.functions import scalars as S
from loreline.operators import texts
from loreline.sources.worlds import World, with_views


def sentences(w: World):
    return texts.sentences(w.chapter(), "chapter_id", "content")


def sentence_stats(w: World):
    return sentences(w).groupBy("chapter_id").agg(F.max("paragraph").alias("last_paragraph"), F.count("*").alias("n_sentences"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def chunk_list(w: World):
    c = texts.chunks(w.chapter(), "chapter_id", "content", 2000, 2)
    new = texts.new_sentences(F.col("sentence_ids"), F.col("overlap_ids"))
    return c.select("chapter_id", "chunk", "start", "end", F.size("sentence_ids").alias("n_sentences"), F.size("overlap_ids").alias("n_overlap"), new[0].alias("first_new"), F.sha2("text", 256).alias("text_sha256"))


def split(w: World):
    """Every manuscript (source) as one text with a heading before each chapter, split again."""
    part = F.concat(F.lit("Chapter "), (F.col("chapter_id") % 9 + 1).cast("string"), F.lit(": "), F.col("lang"), F.lit("\n"), F.col("content"))
    made = w.chapter().withColumn("text", F.concat(F.lit("\n\n"), part, F.lit("\n\nEPILOGUE one\nEnd.")))
    return texts.split_chapters(made, "chapter_id", "text").select("chapter_id", "chapter_number", "title", F.length("content").alias("n_chars"))


def located(w: World):
    """Where the second word of a chapter is best shown, with its first word as name."""
    words = F.split("content", r"\s+")
    rows = w.chapter().withColumns({"values": F.slice(words, 2, 1), "names": F.slice(words, 1, 1)})
    return texts.locate(rows, "chapter_id", "content", "values", "names")


def invariants(w: World):
    return texts.broken_spans(sentences(w), w.chapter(), "chapter_id", "content").agg(F.count("*").alias("n_broken"))


def shape(w: World):
    t = F.col("content")
    return w.chapter().select(
        "chapter_id", S.content_hash(t).alias("content_sha256"), F.size(F.split(t, "\n\n", -1)).cast("long").alias("n_blocks"),
        S.line_number(t, F.lit(100)).cast("long").alias("line_at_100"), F.length(t).cast("long").alias("n_chars"),
    )


def word_counts(w: World):
    return w.chapter().groupBy("manuscript_id").agg(F.sum(S.word_count(F.col("content"))).alias("n_words"), F.count("*").alias("n_chapters"))


def whole_word(w: World):
    return w.chapter().select("chapter_id", S.find_whole_word(F.col("content"), F.lit("the")).cast("long").alias("at")).where("at IS NOT NULL")


def turns(w: World):
    """Quotes (conversation turns) with their folded text and kind of first word."""
    t = w.raw("conversations")
    return t.select("conv_id", "turn", S.mention_kind(F.split(F.trim("text"), " ")[0]).alias("kind"), S.severity(F.col("turn") / 4).alias("severity"))


def names(w: World):
    """Name functions over made-up names with titles, articles and genitives."""
    n = w.raw("customer").select(
        "c_custkey",
        F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Mr. ", "Mrs. ", "Captain ", "", "the ", "Dr. Prof. ")]), (F.col("c_custkey") % 6 + 1).cast("int")), F.lit("Ada "), F.initcap("c_mktsegment"), F.element_at(F.array(F.lit(""), F.lit("'s wife"), F.lit(" of Averly")), (F.col("c_custkey") % 3 + 1).cast("int"))).alias("name"),
    )
    c = F.col("name")
    return n.select("c_custkey", S.without_titles(c).alias("untitled"), S.title_gender(c).alias("gender"), S.spouse_name(c).alias("spouse"), S.is_proper_name(c).alias("proper"), S.name_key(c).alias("key"), S.slug(c).alias("slug"))


def ages(w: World):
    words = F.element_at(F.array(*[F.lit(x) for x in ("thirty", "twenty-four years old", "seven", "17", "45 years", "200", "young", "ninety nine", "twenty zero", " 8 year ")]), (F.col("event_id") % 10 + 1).cast("int"))
    return w.raw("events").select("event_id", S.parse_age(words).alias("age"), S.life_state(F.element_at(F.array(F.lit("Dead"), F.lit(" alive "), F.lit("missing")), (F.col("event_id") % 3 + 1).cast("int"))).alias("state"))


QUERIES = {
    "sentences": (sentence_stats, None),
    "chunks": (chunk_list, None),
    "split_chapters": (split, None),
    "locate_sentence": (located, None),
    "segmentation_invariants": (invariants, "SELECT CAST(0 AS BIGINT) AS n_broken"),
    "chapter_shape": (
        shape,
        with_views("SELECT chapter_id, sha256(content) AS content_sha256, len(string_split(content, chr(10) || chr(10))) AS n_blocks, length(content[:100]) - length(replace(content[:100], chr(10), '')) + 1 AS line_at_100, length(content) AS n_chars FROM chapter", "chapter"),
    ),
    "word_counts": (
        word_counts,
        with_views(r"SELECT manuscript_id, CAST(sum(CASE WHEN trim(content) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ')) END) AS BIGINT) AS n_words, count(*) AS n_chapters FROM chapter GROUP BY 1", "chapter"),
    ),
    "find_whole_word": (
        whole_word,
        with_views(r"SELECT chapter_id, CAST(length(regexp_extract(content, '^(|(?s:.)*?[^\pL\pN_])(?i:the)($|[^\pL\pN_])', 1)) AS BIGINT) AS at FROM chapter WHERE regexp_matches(content, '(^|[^\pL\pN_])(?i:the)($|[^\pL\pN_])')", "chapter"),
    ),
    "mention_kinds": (
        turns,
        r"""SELECT conv_id, turn, CASE WHEN lower(f) IN ('i','me','my','you','he','him','his','she','her','hers','it','its','we','us','they','them','their') THEN 'pronominal' WHEN regexp_matches(f, '^\p{Lu}') THEN 'proper' ELSE 'nominal' END AS kind,
            CASE WHEN turn / 4 >= 0.85 THEN 'high' WHEN turn / 4 >= 0.6 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT *, string_split(trim(text), ' ')[1] AS f FROM conversations)""",
    ),
    "name_functions": (
        names,
        r"""WITH n AS (SELECT c_custkey, ['Mr. ', 'Mrs. ', 'Captain ', '', 'the ', 'Dr. Prof. '][c_custkey % 6 + 1] || 'Ada ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ['', '''s wife', ' of Averly'][c_custkey % 3 + 1] AS name FROM customer),
            u AS (SELECT *, regexp_replace(name, '^((?i:mr|mrs|captain|dr|prof)\.* )+', '') AS untitled, lower(regexp_extract(name, '^(\S+?)\.* ', 1)) AS t FROM n)
            SELECT c_custkey, untitled, CASE t WHEN 'mr' THEN 'm' WHEN 'mrs' THEN 'f' END AS gender,
                CASE WHEN name LIKE '%''s wife' AND t = 'mr' THEN 'Mrs. ' || string_split(replace(name, '''s wife', ''), ' ')[-1] END AS spouse,
                NOT name LIKE '%''s %' AS proper, lower(regexp_replace(untitled, '^the ', '')) AS key,
                trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM u""",
    ),
    "ages_and_states": (
        ages,
        "SELECT event_id, [30, 24, 7, 17, 45, NULL, NULL, 99, NULL, 8][event_id % 10 + 1] AS age, ['DEAD', 'ALIVE', NULL][event_id % 3 + 1] AS state FROM events",
    ),
}
