"""Pages are read in one pass, and patterns are searched by their first characters."""

import random
import re

import pytest
from evidencelake import config as C
from evidencelake.functions import cleanup
from evidencelake.functions import text as T
from evidencelake.operators import extraction as E
from evidencelake.operators import pages as P
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_once(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "http://h/1", "<p>é &amp; words</p>")], "page_id long, url string, html string").write.parquet(path)
    shown = plan(E.read_pages(spark.read.parquet(path)))
    assert shown.count("FileScan") == shown.count("[_pages(") == 1


def test_sanitize_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    rows = [(1, " plain  text \n\n\n\n x "), (2, "ﬁ &amp; é"), (3, None), (4, "a\x0bb"), (5, "")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    df = cleanup.sanitize(spark.read.parquet(path), "text")
    assert plan(df).count("FileScan") == 1
    assert {r["id"]: r["text"] for r in df.collect()} == {1: "plain text\n\nx", 2: "fi & é", 3: "", 4: "a b", 5: ""}


@pytest.mark.parametrize("pattern", [T.NAV, C.LEADING_UI, C.TRAILING, C.SHELL_LINE, C.CUT_LINE, C.COMMENT_UI, C.COMMENT_ITEM])
def test_scans_match_as_the_patterns_do(spark, pattern):
    rng = random.Random(3)
    words = [re.sub(r"\\b|\^|\$|\(\?:|\\d\+", "", x).replace(r"\s+", " ").replace(r"\s*", " ").replace("?", "") for x in re.split(r"\|", pattern)]
    pieces = [w for w in words if w] + ["x", " ", "\n", "Home", "COMMENTS", "reply 3", "留言12", "更多新的報導", "é", "home_", "_home", "signin"]
    texts = ["".join(rng.choice(pieces) + rng.choice(("", " ", "\n")) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + words
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit("(?i)" + p), 0)
    got = df.select("t", found(pattern).alias("a"), found(T.scan(pattern)).alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == [] and any(r["a"] for r in got)


def test_a_scan_wants_plain_beginnings():
    for pattern in ("(?:a?b|c)", r"(?:\d|x)", r"(?:a|\ba)"):
        with pytest.raises(ValueError):
            T.scan(pattern)


def test_links_go_step_by_step(spark):
    given = ["a [b](c) ![i](j)\r\n\r\n\r\n\r\nx \t y", " \u3000 lead\n \n tail \xa0", "[ ]( u ) [k](javascript:void(0)) javascript:void(1)", '; "t") __ Advertisement__ Advertisement advertisements', "", None, "a\u2003 b\n  \n\n \nc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").select(T.strip_md_links(F.col("t"))).collect()]
    assert got == ["a b\n\nx y", "lead\n\ntail", "k)", "advertisements", "", "", "a b\n\nc"]


def test_a_site_probe_reads_texts_once(spark, tmp_path):
    path = str(tmp_path / "pages")
    prose = "This is a sentence of the story that goes on for a while, with a comma and then an end. " * 8
    rows = [(1, "http://h/1", f"<p>{prose}</p><a href='/2'>two</a>"), (2, "http://h/2", f"<p>{prose}</p>"), (3, "http://h/3", "<p>tiny</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(path)
    pages, words = spark.read.parquet(path), spark.createDataFrame([(0, "story")], "ordinal int, keyword string")
    probe = P.site_probe(pages, pages, words)
    assert plan(probe).count("[_pages(") == 1  # for the links
    assert sorted((r["seed_id"], r["page_id"], r["ok"], len(r["snippets"])) for r in probe.collect()) == [(1, 1, True, 2), (1, 2, True, 2), (2, 2, True, 2), (3, 3, False, 0)]
