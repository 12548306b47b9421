"""SQL twins of pages read character references as the operators do."""

import html
from html.entities import html5

import duckdb
import pytest
from evidencelake.functions.markup import read_page
from evidencelake.plans import pages

CUT = ["a &amp", "the&&& end&&amp", "&ampx &ltgt; &notit; &notin; &NOTIT;", "&lt &gt; &quot;&#39;&amp;lt;", "& &; &# &#; &#x; &unknown; &\n", "x&nbsp;y &eacute &eacute;&CounterClockwiseContourIntegral;"]
NUMBERS = [f"a&#{n};b&#x{n:x}c&#X000{n:X} ." for n in (*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0x1FFFF, 0x10FFFE, 0x10FFFF, 0x110000, 0xFFFFFFFF, 10**30)]


def test_character_references():
    texts = [*CUT, *NUMBERS, *(f"&{name} &{name}x;" for name in html5)]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (i INT, x VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = [r[0] for r in db.sql(f"SELECT {pages.entities_sql('x')} FROM t ORDER BY i").fetchall()]
    assert got == [html.unescape(x) for x in texts]


def test_pages_with_cut_references():
    sources = [f"<title>{x}</title><h1>A heading <b>of {x}</b></h1><article><p>{x}</p>\n<p>two\n\n\n\nlines &nbsp;</p></article>" for x in (*CUT, "　wide\x85")]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(sources)))
    found = [read_page(x) for x in sources]
    assert [r[1] for r in sorted(db.sql(f"WITH {pages.PAGE_T} SELECT id, text FROM t").fetchall())] == [f["text"] for f in found]
    assert [r[1] for r in sorted(db.sql(f"SELECT * FROM ({pages.F19_SQL})").fetchall())] == [f["h1"] for f in found]
    assert [r[1] for r in sorted(db.sql(f"SELECT page_id, text FROM ({pages.F18_ALONE})").fetchall())] == [f["main"] for f in found]


@pytest.mark.parametrize(("query", "sql"), [(pages.p12_needs_render, pages.P12_SQL), (pages.p14_choose_extraction, pages.P14_SQL)])
def test_thresholds_with_cut_references(spark, tmp_path, query, sql):
    """Texts that fall short of a limit by the length of a cut reference: it decides on rendering and on the way of extraction."""
    words = ("Words of a sentence, as they come and go. " * 20).replace(". W", ".\nW")
    sources = [f"<article><p>{words[:n]}x&amp</p></article>" for n in (*range(34, 46), *range(108, 126), *range(208, 226), *range(436, 456), *range(640, 656))]
    rows = [(i * len(sources) + k, f"https://e.example/{k}", x) for i in range(2) for k, x in enumerate(sources)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(db.sql(sql).fetchall())
