import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls, empty, short and repeated texts, ties, other scripts, and a text of 200,000 characters."""
    words = "the of and thion re ing at on er stand light river".split()
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    shared = prose(60)
    texts = [None, "", "a", "a", " \n\t", "é漢😀 " * 40, shared, shared, f"{prose(30)} {shared} {prose(30)}", f"{shared[:200]}X{shared[200:]}", "x" * 500, "ab" * 300, prose(35_000), "don't <|endoftext|> stop", "\x00\x01 odd"]
    texts += [prose(rng.randrange(5, 120)) for _ in range(25)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """As documents, with a column named like one that operators make."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "n_tokens": F.lit(-1)}).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
