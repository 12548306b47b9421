import random

import pytest
from evidencelake.operators import pages as P
from pyspark.sql import functions as F


def test_all_keywords_are_probed(spark):
    keywords = spark.createDataFrame([(f"k{i:03d}",) for i in range(150)], "keyword string")
    pages = spark.createDataFrame([(1, "K149 and k003"), (2, None), (3, "none")], "page_id long, text string")
    assert sorted((r["page_id"], r["keyword"]) for r in P.keyword_probe(pages, keywords).collect()) == [(1, "k003"), (1, "k149")]


def test_snippets_after_many_alike(spark):
    text = "ab " * 400 + "z" * 100 + " ab " + "y" * 100
    rows = spark.createDataFrame([(text, "AB"), ("x", "ab"), (None, "ab")], "t string, k string").select(P.kwic(F.col("t"), F.col("k"), 2, 6).alias("s")).collect()
    low = text.lower()
    starts = [i for i in range(len(low)) if low.startswith("ab", i)]
    cut = lambda p: ("..." if p > 2 else "") + text[max(0, p - 2) : p + 4] + ("..." if p + 4 < len(text) else "")
    want = list(dict.fromkeys(map(cut, starts)))[:6]
    assert rows[0]["s"] == want and "z ab y" in want[-1] and rows[1]["s"] == rows[2]["s"] == []


@pytest.mark.parametrize("most_bytes", [8 << 20, 0])
def test_many_keywords_equal_contains(spark, most_bytes):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdeÀéß漢😀 ") for _ in range(k))
    words = [word(rng.randint(1, 5)) for _ in range(3000)] + ["", "AB", "ab", "aB", "not there at all", None]
    texts = [(i, word(rng.randint(0, 60)).upper() if i % 2 else word(rng.randint(0, 60)), "x", 1) for i in range(80)] + [(80, None, "x", 1), (81, "", "x", 1), (82, "ab", "x", 1), (82, "ab", "x", 1)]
    pages = spark.createDataFrame(texts, "id int, text string, ordinal string, _n int").repartition(3)
    got = P.keyword_probe(pages, spark.createDataFrame([(w,) for w in words], "keyword string"), *([most_bytes] if most_bytes == 0 else []))
    assert sorted(got.columns) == sorted([*pages.columns, "keyword"])
    low = lambda t: spark.createDataFrame([(x,) for x in t], "t string").selectExpr("lower(t)").collect()
    lowered = [r[0] or "" for r in low([t for _, t, *_ in texts])]
    known = sorted({w for w in words if w is not None})
    small = dict(zip(known, (r[0] for r in low(known))))
    want = sorted((i, w) for (i, *_), t in zip(texts, lowered) for w in known if small[w] in t)
    assert sorted((r["id"], r["keyword"]) for r in got.collect()) == want


def test_no_keywords(spark):
    pages = spark.createDataFrame([(1, "a")], "id int, text string")
    none = spark.createDataFrame([], "keyword string")
    assert P.keyword_probe(pages, none).count() == 0 and P.keyword_probe(pages, none, -1).count() == 0
