"""Both modes of reading pages against the same chain walked page by page, and hand-made pages."""

import pytest
from evidencelake.operators import extraction as E
from evidencelake.operators import jobs
from evidencelake.operators import pages as P
from evidencelake.operators import trimming as M
from pyspark.sql import functions as F

PROSE = "This is a sentence of the story that goes on for a while, with a comma and then an end. "


def shell(n):
    return "".join(f"<div>Menu {i}</div>" for i in range(n))


ROWS = [
    (1, f"<title>A story of some length</title><nav>x</nav><article><h1>A story of some length</h1><p>{PROSE * 8}</p></article>"),
    (2, f"<title>Plain</title>{shell(14)}<h2>Heading</h2><p># Heading here</p><p>{PROSE * 9}</p>"),
    (3, f"<p>{'lead in words without end ' * 5}</p><p># First heading</p><p>{PROSE * 7}</p>"),
    (4, f"<main>short main part of thirty characters</main><p>{PROSE * 20}</p>"),
    (5, "<p>tiny</p>"), (6, ""), (7, None), (8, f"<article>{PROSE}</article><article>{PROSE * 3}</article>"), (9, f"<nav>{PROSE}</nav>"),
    (10, f"<title>Titled page here</title>{shell(20)}<p>Titled page here</p><p>{PROSE * 6}</p><p>Related articles</p><p>Read more</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"http://h/{i}", h, "x", 1) for i, h in ROWS], "page_id long, url string, html string, mode string, i int").repartition(3)


def test_modes_by_walking_each_page(spark, pages):
    tables = {}
    for mode in ("general", "strict"):  # each mode alone, candidate by candidate
        found = E.candidates(pages)
        scored = E._measured(M.postprocess(found.filter("i >= 0"), mode)).withColumn("noise", P.noise_penalty(F.col("text"), F.col("title"))).withColumn("score", E.candidate_score(mode))
        best = {}
        for r in sorted(scored.collect(), key=lambda r: (r["page_id"], r["i"])):
            if r["page_id"] not in best or r["score"] > best[r["page_id"]]["score"]:
                best[r["page_id"]] = r
        tables[mode] = best
    got = {r["page_id"]: r for r in E.attempts(pages).withColumn("m", F.explode("modes")).filter("m = 'general'").collect()}
    strict = {r["page_id"]: r for r in E.attempts(pages).withColumn("m", F.explode("modes")).filter("m = 'strict'").collect()}
    assert set(got) == set(strict) == {i for i, _ in ROWS}
    for mode, rows in (("general", got), ("strict", strict)):
        for i, best in tables[mode].items():
            assert (rows[i]["source"], rows[i]["title"]) == (best["source"], best["title"])
            steps = lambda r: [(s["step"], s["after"]) for s in r["steps"] if s["step"] not in ("heading", "pipeline")]
            assert steps(rows[i]) == steps(best)
    chosen = {r["page_id"]: r for r in E.read_pages(pages).collect()}
    for i, _ in ROWS:
        s, g = strict[i], got[i]
        longer = s["quality"]["usable"] and g["quality"]["usable"] and g["metrics"]["text_len"] >= max(240, int(s["metrics"]["text_len"] * 1.45))
        general = not s["quality"]["acceptable"] and (g["quality"]["acceptable"] or (g["quality"]["usable"] and not s["quality"]["usable"]) or longer)
        assert chosen[i]["mode"] == ("general" if general else "strict") and chosen[i]["text"] == (g if general else s)["text"]


def test_pages_read(pages):
    got = {r["page_id"]: r for r in E.read_pages(pages).collect()}
    assert got[1]["source"] == "html_article" and got[1]["text"].startswith("A story of some length\nThis is")
    assert got[6]["quality"]["reason"] == got[7]["quality"]["reason"] == "EMPTY_CONTENT" and got[6]["text"] == ""
    assert got[5]["text"].endswith("tiny") and not got[5]["quality"]["usable"]
    assert got[4]["source"] == "html_fallback"
    texts = {r["url"] for r in jobs.page_texts(pages.drop("mode", "i")).collect()}
    assert texts == {r["url"] for r in got.values() if r["quality"]["usable"]}


def test_strict_begins_at_a_heading(spark):
    rows = [("lead " * 20 + "# Head\n" + PROSE * 3, ""), ("# Head\n" + PROSE, ""), ("a [b](c) " * 12 + "# Head\n" + PROSE, "")]
    df = spark.createDataFrame(rows, "text string, title string")
    strict = [r["text"] for r in M.postprocess(df, "strict").collect()]
    assert strict[0].startswith("# Head") and strict[1].startswith("# Head") and strict[2].startswith("a b")  # links were taken out of the third
    both = [(r["mode"], r["text"][:4]) for r in M.postprocess(df, "both").collect()]
    assert both == [("general", "lead"), ("strict", "# He"), ("both", "# He"), ("both", "a b ")]
