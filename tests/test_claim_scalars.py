"""Scalar functions on claims, answers and editions."""

import pytest
from pyspark.sql import functions as F

from loreline.functions import scalars as S


@pytest.fixture(scope="module")
def one(spark):
    def value(make, **columns):
        """make of the columns, whose values are strings, numbers or null."""
        kinds = {k: "int" if isinstance(v, int) else "string" for k, v in columns.items()}
        row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
        return row.select(make(*[F.col(k) for k in columns]).alias("x")).first().x

    return value


def test_fact_keys(one):
    assert one(S.fact_keys, p="age", v=" About  Thirty ", s=None, a=30) == ["age|about thirty", "age|age:30"]
    assert one(S.fact_keys, p="status", v="drowned", s="DEAD", a=None) == ["status|DEAD"]
    assert one(S.fact_keys, p="origin", v="The  North", s=None, a=None) == ["origin|the north"]


@pytest.mark.parametrize("answer, want", [(" Mara  Quinn. ", "Mara Quinn"), ("Unknown", None), ("n/a;", None), ("", None), (None, None), ("none of them", "none of them")])
def test_answer_value(one, answer, want):
    assert one(S.answer_value, a=answer) == want


def test_explanations_carry_their_rule(one):
    told = one(S.stored_explanation, r="AGE_MONOTONIC", t="31 then 30")
    assert told == "[AGE_MONOTONIC] 31 then 30" and one(S.rule_of_explanation, t=told) == "AGE_MONOTONIC"
    assert one(S.rule_of_explanation, t="no rule [X] here") is None and one(S.rule_of_explanation, t=None) is None


def test_negative_predicates_and_editions(one):
    assert one(S.is_negative, p="ENEMY_OF") and not one(S.is_negative, p="FRIEND_OF")
    assert one(S.fold_edition, t="‘It’s “so”") == "'It's \"so\""


@pytest.mark.parametrize("start, end, surface, want", [(0, 3, "The", None), (0, 2, "Th", "cuts a word"), (4, 7, "dog", "differs"), (4, 99, "cat", "outside"), (5, 5, "", "outside"), (-1, 3, "The", "outside")])
def test_span_problem(one, start, end, surface, want):
    assert one(S.span_problem, t="The cat 😀 sat", s=start, e=end, x=surface) == want
