"""Texts of a corpus whose characters were lost, put right by a reference edition line by line, and spans moved along.

A corpus writes straight double quotes for typographic ones and spaces for what is not ASCII: one a character (mode char) or
one a UTF-8 byte (mode bytes, where a closing single quote is a straight one too). A line comes back if exactly one line of the
edition would be written as it is; all others stay as they are and are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreline.operators import spans

#: Characters by the bytes that they have in UTF-8.
_BYTES = {2: r"[\x{80}-\x{7FF}]", 3: r"[\x{800}-\x{FFFF}]", 4: r"[\x{10000}-\x{10FFFF}]"}
_OTHER = r"[^\x{0}-\x{7F}]"


def _straight(line: Column, mode: str) -> Column:
    """What a corpus keeps of typographic quotes."""
    return F.translate(line, "“”’" if mode == "bytes" else "“”", '""\'' if mode == "bytes" else '""')


def corpus_form(line: Column, mode: str = "char") -> Column:
    """line as the corpus writes it."""
    line = _straight(line, mode)
    if mode == "char":
        return F.regexp_replace(line, _OTHER, " ")
    for n, found in _BYTES.items():
        line = F.regexp_replace(line, found, " " * n)
    return line


def restored_line(line: Column, mode: str = "char") -> Column:
    """line of an edition as it comes back: a single quote that had become a space is a straight one."""
    return F.translate(_straight(line, mode), "‘’", "''")


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))


def matched_lines(texts: DataFrame, edition: DataFrame, mode: str = "char") -> DataFrame:
    """Lines of texts (doc, text): doc, n, line, original (of the edition; null if none or several fit) and lost (characters that
    come back). edition: doc, text; several rows of a document are one edition."""
    every = _lines(edition.select("doc", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text")))
    known = every.groupBy("doc", corpus_form(F.col("line"), mode).alias("form")).agg(F.count_distinct("line").alias("several"), F.min("line").alias("original")).where("several = 1").drop("several")
    rows = _lines(texts).join(known.withColumnRenamed("form", "line"), ["doc", "line"], "left")
    lost = F.length(F.regexp_replace(_straight(F.col("original"), mode), r"[\x{0}-\x{7F}]", ""))
    return rows.select("doc", "n", "line", "original", F.coalesce(lost, F.lit(0)).alias("lost"))


def restored(lines: DataFrame, mode: str = "char") -> DataFrame:
    """doc, text, restored (characters) and unmatched (lines that are not blank and stayed, in order), of matched_lines."""
    line = F.coalesce(restored_line(F.col("original"), mode), "line")
    left = F.when(F.col("original").isNull() & F.col("line").rlike(r"(?U)\S"), F.col("line"))
    rows = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line"), left.alias("left")))).alias("x"), F.sum("lost").alias("restored"))
    return rows.select("doc", F.array_join(F.col("x.line"), "\n").alias("text"), "restored", F.array_compact(F.col("x.left")).alias("unmatched"))


def pieces(lines: DataFrame, mode: str = "char") -> DataFrame:
    """Where the text of a corpus went: doc, start, end (offsets there), to (where start went) and flat (all of the piece went to
    the one character at to; else it moved as it is). The pieces of a document cover it and one place behind its end.

    A piece is a line, or in mode bytes a stretch of ASCII or one other character of a restored line. Its places are
    running sums of lengths on both sides.
    """
    wide = F.when(F.col("original").isNotNull(), F.regexp_extract_all(_straight(F.col("original"), mode), F.lit(f"({_OTHER}|[\\x{{0}}-\\x{{7F}}]+)"), F.lit(1)))
    parts = F.coalesce(wide, F.array("line")) if mode == "bytes" else F.array("line")
    # every line is followed by its end; that of the last one is the place behind the text
    rows = lines.select("doc", "n", F.posexplode(F.concat(parts, F.array(F.lit("\n")))).alias("k", "part"), F.col("original").isNotNull().alias("back"))
    flat = F.lit(mode == "bytes") & F.col("back") & F.col("part").rlike(f"^{_OTHER}$")
    rows = rows.select("doc", "n", "k", flat.alias("flat"), F.when(flat, F.octet_length("part")).otherwise(F.length("part")).alias("old"), F.when(flat, 1).otherwise(F.length("part")).alias("new")).where("old > 0")
    upto = W.partitionBy("doc").orderBy("n", "k")
    return rows.select("doc", (F.sum("old").over(upto) - F.col("old")).alias("start"), F.sum("old").over(upto).alias("end"), (F.sum("new").over(upto) - F.col("new")).alias("to"), "flat")


def moved(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Half-open spans (doc, id, start, end; further columns stay) of a corpus text in the restored one, by its pieces. The end
    is one behind where the last character went. Spans outside their text are lost."""
    ends = F.array(F.struct(F.lit("s").alias("side"), F.col("start").alias("at")), F.struct(F.lit("e").alias("side"), F.greatest(F.col("end") - 1, F.col("start")).alias("at")))
    points = rows.select("doc", "id", F.explode(ends).alias("p")).select("doc", "id", "p.side", "p.at")
    held = spans.at_points(points, of, ["doc"], "at")
    to = F.when(F.col("r.flat"), F.col("r.to")).otherwise(F.col("r.to") + F.col("l.at") - F.col("r.start"))
    both = held.groupBy("doc", F.col("l.id").alias("id")).agg(F.max(F.when(F.col("l.side") == "s", to)).alias("_s"), F.max(F.when(F.col("l.side") == "e", to)).alias("_e"))
    out = rows.join(both.where("_s IS NOT NULL AND _e IS NOT NULL"), ["doc", "id"])
    empty = F.col("start") == F.col("end")
    return out.select(*[{"start": F.col("_s"), "end": F.when(empty, F.col("_s")).otherwise(F.col("_e") + 1)}.get(c, F.col(c)).alias(c) for c in rows.columns])


def trimmed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (doc, id, start, end, expected) without the white space at their ends, and found: whether the text (doc, text) has there what
    is expected, its own white space off. Only spans that are found may move; the others are the issues of a conversion."""
    x = rows.join(texts.select("doc", F.col("text").alias("_text")), "doc")
    inner = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    bare = F.regexp_replace(inner, r"(?U)^\s+", "")
    first = F.col("start") + F.length(inner) - F.length(bare)
    clean = F.regexp_replace(bare, r"(?U)\s+$", "")
    want = F.regexp_replace("expected", r"(?U)^\s+|\s+$", "")
    new = {"start": first, "end": first + F.length(clean)}
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns], (clean == want).alias("found"))


def with_elision(rows: DataFrame, texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Moved spans (doc, id, start, end, was: their start in the corpus) that begin behind an apostrophe which came back from a space
    take it in: a letter or digit follows it ('tis)."""
    x = rows.join(texts.select("doc", F.col("text").alias("_t")), "doc").join(corpus.select("doc", F.col("text").alias("_c")), "doc")
    cut = (F.col("start") > 0) & (F.substring("_t", F.col("start"), F.lit(1)) == "'") & (F.substring("_c", F.col("was"), F.lit(1)) == " ") & F.substring("_t", F.col("start") + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]$")
    return x.select(*[(F.when(cut & (F.col("was") > 0), F.col("start") - 1).otherwise(F.col("start")) if c == "start" else F.col(c)).alias(c) for c in rows.columns])


def speaker_keys(names: DataFrame, characters: DataFrame, name_map: DataFrame, special: list[str]) -> DataFrame:
    """Whom a corpus means by a name (work, name): entity_key (null for a group, someone unknown, or a problem) and how: map, special,
    main, alias, ambiguous or unknown. Tiers of joins, of which the first that holds a name decides.

    characters: work, entity_key, main, aliases (array). name_map: work, name, entity_key (null: no one). special: names that stand for
    groups or the unknown.
    """
    plain = characters.where(~F.col("main").isin(*special))
    main = plain.groupBy("work", F.col("main").alias("name")).agg(F.max("entity_key").alias("_main"))
    alias = plain.select("work", "entity_key", F.explode("aliases").alias("name")).groupBy("work", "name").agg(F.count_distinct("entity_key").alias("_n"), F.min("entity_key").alias("_alias"))
    given = name_map.select("work", "name", F.col("entity_key").alias("_map"), F.lit(True).alias("_mapped"))
    rows = names.join(given, ["work", "name"], "left").join(main, ["work", "name"], "left").join(alias, ["work", "name"], "left")
    how = (
        F.when(F.col("_mapped"), "map").when(F.col("name").isin(*special), "special").when(F.col("_main").isNotNull(), "main")
        .when(F.col("_n") == 1, "alias").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    )
    key = F.when(how == "map", F.col("_map")).when(how == "main", F.col("_main")).when(how == "alias", F.col("_alias"))
    return rows.select(*names.columns, key.alias("entity_key"), how.alias("how"))


def converted_quotes(rows: DataFrame, corpus: DataFrame, lines: DataFrame, chapters: DataFrame, characters: DataFrame, name_map: DataFrame, special: list[str], mode: str = "char") -> tuple[DataFrame, DataFrame]:
    """Quotations of a corpus as quotes of chapters, and what is wrong with them.

    rows: work, quote_id, spans (array of start, end), parts (array of texts, one a span), speaker. corpus: doc (the work), text; lines:
    matched_lines of it. chapters: work, number, start and end in the restored text. Returns quotes (work, number, quote_id, place
    (from 1, by start), pieces (in the chapter), speaker) and issues (work, quote_id, issue, detail): a quote that lies across a
    chapter's end goes (crosses), a piece that the corpus does not have there goes (differs), a quote without pieces goes
    with them; a speaker who is not told has a null key (ambiguous, unknown).
    """
    flat = rows.select(F.col("work").alias("doc"), "quote_id", F.posexplode(F.arrays_zip("spans", "parts")).alias("k", "x"))
    flat = flat.select("doc", F.struct("quote_id", "k").alias("id"), F.col("x.spans.start").alias("start"), F.col("x.spans.end").alias("end"), F.col("x.parts").alias("expected"))
    of = pieces(lines, mode)
    near = moved(flat.select("doc", "id", "start", "end"), of).select("doc", "id", "start", "end")
    in_chapter = spans.overlapping(near, chapters.select(F.col("work").alias("doc"), "number", "start", "end"), ["doc"])
    whole = (F.col("r.start") <= F.col("l.start")) & (F.col("l.end") <= F.col("r.end"))
    sizes = rows.select(F.col("work").alias("doc"), "quote_id", F.size("spans").alias("n"))
    touched = in_chapter.groupBy("doc", F.col("l.id.quote_id").alias("quote_id"), F.col("r.number").alias("number"), F.col("r.start").alias("first")).agg(F.count_if(whole).alias("inside")).join(sizes, ["doc", "quote_id"])
    crossing = touched.groupBy("doc", "quote_id").agg(F.max(F.col("inside") == F.col("n")).alias("ok")).where("NOT ok")
    home = touched.where("inside = n").select("doc", "quote_id", "number", "first")

    checked = trimmed(flat, corpus).withColumn("was", F.col("start"))
    sound = moved(checked.where("found").select("doc", "id", "start", "end", "was"), of)
    sound = with_elision(sound, restored(lines, mode), corpus).select("doc", F.col("id.quote_id").alias("quote_id"), F.col("id.k").alias("k"), "start", "end")
    got = sound.join(home, ["doc", "quote_id"]).groupBy("doc", "quote_id", "number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("start") - F.col("first")).alias("start"), (F.col("end") - F.col("first")).alias("end")))), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("pieces")
    )
    who = speaker_keys(rows.select("work", "quote_id", F.col("speaker").alias("name")), characters, name_map, special)
    out = got.withColumnRenamed("doc", "work").join(who, ["work", "quote_id"])
    place = F.row_number().over(W.partitionBy("work", "number").orderBy(F.col("pieces")[0]["start"], "quote_id"))
    quotes = out.select("work", "number", "quote_id", place.alias("place"), "pieces", F.col("entity_key").alias("speaker"))

    wrong = lambda df, issue, detail: df.select(F.col("doc").alias("work"), "quote_id", F.lit(issue).alias("issue"), detail.alias("detail"))
    differs = checked.where("NOT found").select("doc", F.col("id.quote_id").alias("quote_id"), "expected").join(home, ["doc", "quote_id"])
    named = who.where("how IN ('ambiguous', 'unknown')").join(quotes.select("work", "quote_id"), ["work", "quote_id"], "left_semi").select("work", "quote_id", F.col("how").alias("issue"), F.col("name").alias("detail"))
    return quotes, wrong(crossing, "crosses", F.lit(None).cast("string")).unionByName(wrong(differs, "differs", F.col("expected"))).unionByName(named)
