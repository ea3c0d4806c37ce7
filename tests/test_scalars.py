import pytest
from pyspark.sql import functions as F

from loreline.functions import scalars as S


def value(spark, make, *args, schema=None):
    schema = schema or ", ".join(f"c{i} string" for i in range(len(args)))
    row = spark.createDataFrame([args], schema).select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()
    return row.v


@pytest.mark.parametrize("text, age", [
    ("30", 30), (" 30 years old ", 30), ("1 year", 1), ("thirty", 30), ("twenty-four years old", 24), ("twenty four", 24), ("seven", 7), ("ninety nine", 99),
    ("150", 150), ("151", None), ("old", None), ("twenty zero", None), ("thirty eleven", None), ("", None), (None, None), ("-3", None), ("3.5", None), ("0", 0),
])
def test_parse_age(spark, text, age):
    assert value(spark, S.parse_age, text) == age


@pytest.mark.parametrize("name, want", [("Eye Color", "eye_color"), ("  --Eye--color ", "eye_color"), (None, ""), ("", "")])
def test_normalize_property(spark, name, want):
    assert value(spark, S.normalize_property, name) == want


@pytest.mark.parametrize("name, want", [("Captain Elias Brandt", "Elias Brandt"), ("Dr. Prof. Weiss", "Weiss"), ("Doctor", "Doctor"), ("Captainess Jo", "Captainess Jo"), ("mr. X", "X"), ("Sir Lady", "Lady")])
def test_without_titles(spark, name, want):
    assert value(spark, S.without_titles, name) == want


@pytest.mark.parametrize("name, want", [("Mr. Bennet's wife", "Mrs. Bennet"), ("Mrs. Hall's husband", "Mr. Hall"), ("Mr. John Hall's lady", "Mrs. Hall"), ("Mara's brother", None), ("Mr.'s wife", None), ("Bennet", None)])
def test_spouse(spark, name, want):
    assert value(spark, S.spouse_name, name) == want


@pytest.mark.parametrize("name, want", [("Mara Quinn", True), ("Port of Averly", True), ("mother", False), ("Mara's oldest friend", False), ("Mr. Bennet's", False), ("Élodie", True), ("", False)])
def test_proper_name(spark, name, want):
    assert value(spark, S.is_proper_name, name) == want


def test_values_equal_and_states(spark):
    assert value(spark, S.values_equal, " Grey", "grey ") and not value(spark, S.values_equal, "grey", None) and value(spark, S.values_equal, None, None)
    assert [value(spark, S.life_state, v) for v in (" Dead", "alive and well", "lost", None)] == ["DEAD", "ALIVE", None, None]


def test_canonical_relation(spark):
    rel = lambda *a: tuple(value(spark, S.canonical_relation, *a))
    assert rel("b", "CHILD_OF", "a") == ("a", "PARENT_OF", "b")
    assert rel("b", "KNOWS", "a") == ("a", "KNOWS", "b") == rel("a", "KNOWS", "b")
    assert rel("b", "OWNS", "a") == ("b", "OWNS", "a")


def test_span_problem(spark):
    check = lambda t, s, e, x: value(spark, S.span_problem, t, s, e, x, schema="c0 string, c1 int, c2 int, c3 string")
    assert check("a😀b cat", 4, 7, "cat") is None
    assert check("a cat", 2, 9, "cat") == "outside"
    assert check("a cat", 2, 5, "dog") == "differs"
    assert check("a cat", 3, 5, "at") == "cuts a word"


def test_rates(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, "exhaustive"), (0, 0, 0, 0, "exhaustive"), (2, 0, 0, 2, "partial"), (0, 0, 0, 3, "none")], "tp int, p_tp int, fp int, fn int, coverage string")
    got = df.select(*S.rates_covered(*[F.col(c) for c in ("tp", "p_tp", "fp", "fn", "coverage")])).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0), (None, None, None), (None, 0.5, None), (None, None, None)]


def test_search_names_and_words(spark):
    row = spark.createDataFrame([("Captain Elias Brandt", ["Eli", "Dr. Brandt"])], "n string, a array<string>").select(S.search_names(F.col("n"), F.col("a")).alias("s"), S.name_words(F.col("n")).alias("w"), S.find_whole_word(F.lit("Elias saw eli."), F.lit("Eli")).alias("at")).first()
    assert row.s == ["Captain Elias Brandt", "Elias Brandt", "Dr. Brandt", "Brandt", "Eli"] and row.w == ["brandt", "elias"] and row.at == 10
