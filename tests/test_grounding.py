"""Facts grounded in chunks: quotes found in exact places, and whom they are told of."""

import random

import pytest
from pyspark.sql import functions as F

from loreline.operators import grounding as G


@pytest.mark.parametrize("evidence, value, text, want", [
    ("Mara is a nurse", "nurse", "😀 So Mara is\n a  NURSE.", (17, "NURSE")),
    ("“It’s Mara’s nurse”", "mara's nurse", "'It's Mara's  nurse'", (6, "Mara's  nurse")),
    ("she ... a red (old) hat, ", "red (old)", "Then she took a red (old) hat", (16, "red (old)")),
    ("she … not there", "she", "Then she took", None), ("Mara", "nurse", "Mara nurse", None), ("", "x", "x", None), (None, "x", "x", None), ("x", "", "x", None), ("...", "x", "x", None),
    ("a.b", "a.b", "aXb a.b", (4, "a.b")), ("tall man", "man", "a man, a tall man", (14, "man")),
])
def test_found_at(spark, evidence, value, text, want):
    r = spark.createDataFrame([(evidence, value, text)], "e string, v string, t string").select(G.found_at(F.col("e"), F.col("v"), F.col("t")).alias("x")).first().x
    assert (None if r is None else (r.start, r.value)) == want


def test_places_hold_in_the_text(spark):
    rng = random.Random(2)
    words = ["the", "Café", "“no”", "it’s", "😀", "a+b", "(x)", "nurse", "C:\\E"]
    rows = []
    for _ in range(60):
        parts = [rng.choice(words) for _ in range(15)]
        text = "".join(w + rng.choice([" ", "  ", "\n"]) for w in parts)
        a, b = sorted(rng.sample(range(15), 2))
        evidence = " ".join(parts[a : b + 1]).upper().replace("“", '"').replace("”", '"').replace("’", "'")
        rows.append((evidence, rng.choice(parts[a : b + 1]).upper(), text))
    got = spark.createDataFrame(rows, "e string, v string, t string").select("v", "t", G.found_at(F.col("e"), F.col("v"), F.col("t")).alias("x")).collect()
    fold = lambda s: s.translate(str.maketrans("“”’", "\"\"'")).lower()
    hits = [r for r in got if r.x is not None]
    assert len(hits) > 40
    for r in hits:
        assert r.t[r.x.start : r.x.start + len(r.x.value)] == r.x.value and fold(r.x.value) == fold(r.v)


def test_grounded(spark):
    text = "Captain Mara Quinn was thirty years old. She came from the north coast.\n\nTom, a tired nurse, knew Mara. The dog slept."
    cut = text.index("Tom")
    chunks = [("d", 0, 0, cut - 2, text[: cut - 2]), ("d", 1, cut, len(text), text[cut:])]
    at = text.index
    sentences = [("d", 0, 40), ("d", 41, cut - 2), ("d", cut, at("The dog") - 1), ("d", at("The dog"), len(text))]
    mentions = [("d", "M1", "mara", "character", "proper", "Captain Mara Quinn", 0), ("d", "M2", "mara", "character", "pronominal", "She", at("She")), ("d", "M3", "tom", "character", "proper", "Tom", cut), ("d", "M4", "mara", "character", "proper", "Mara", at("Mara.")), ("d", "M5", "dog", "object", "nominal", "The dog", at("The dog"))]
    answers = [
        (0, 1, "Mara Quinn", "age", "Thirty years  old", "captain mara quinn was thirty years old"), (0, 2, "captain mara quinn", "origin", "North coast", "She came from the north coast"), (0, 3, "Mara Quinn", "age", "thirty years old", "was thirty years old"),
        (0, 4, "Tom", "occupation", "nurse", "a tired nurse"), (0, 5, "Mara Quinn", "title", "Captain", "Captain Mara Quinn"), (1, 1, "Tom", "occupation", "tired nurse", "Tom ... tired nurse"), (1, 2, "Mara", "species", "human", "Mara"),
        (1, 3, "The dog", "occupation", "dog", "The dog slept"), (1, 4, "Tom", "occupation", "baker", "a tired baker"), (1, 5, "Mara", "occupation", "knew", "knew Mara"), (1, 6, None, "age", "thirty", None),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = G.grounded(
        df([("d", *a) for a in answers], "doc string, chunk int, place int, name string, property string, value string, evidence string"), df(chunks, "doc string, chunk int, start int, end int, text string"), df([("d", text)], "doc string, text string"),
        df(mentions, "doc string, mention_id string, entity string, type string, kind string, text string, start int"), df(sentences, "doc string, start int, end int"), df([("d", "mara", "occupation", "Knew")], "doc string, entity string, property string, value string"),
    )
    got = sorted((r.fact_id, r.property, r.value, r.mention_id, text[r.start : r.end]) for r in out.collect())
    assert got == [
        ("F2", "age", "thirty years old", "M1", "thirty years old"), ("F3", "origin", "the north coast", "M1", "the north coast"), ("F4", "title", "Captain", "M1", "Captain"), ("F5", "occupation", "tired nurse", "M3", "tired nurse"),
    ]
