import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, n int, uid string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    full = [(i, t, lang, src, len(t or ""), "x", 1, 2, "u") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, null ids, near copies and one very long text."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ion", "é", "ou", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(n))
    base = prose(150)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, base, "en", "a"), (5, base, "fr", "b"), (6, base.replace(" ", "  "), "fr", None), (7, base + " end", "en", "a")]
    rows += [(8, "tie", "en", "a"), (8, "tie", "en", "a"), (None, "tie", None, "b"), (9, prose(30_000), "en", "c"), (10, "漢字 😀 ☃ " * 40, "fr", "c"), (11, "12 34 !!", None, "c")]
    rows += [(20 + i, prose(rng.randint(20, 300)), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, []).repartition(1)
