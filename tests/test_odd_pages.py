"""SQL twins of pages agree with the queries on null and empty pages, articles that show nothing, pages that are cut off, and bare < and >."""

import duckdb
import pytest
from evidencelake.plans import pages

PAGE = '<!DOCTYPE html><html lang="en"><head><title>{0}</title><script>var t="</p>";</script></head><body><nav><ul><li>x</li></ul></nav><!-- a <b> -- > --><div class="ad">An attention.</div><article><h1>{0}</h1><p>{1}</p></article><footer>&copy; x</footer></body></html>'
LONG = "Words of being in a sentence, as they come and go at present. " * 12
SOURCES = [
    None, "", PAGE.format("", ""), PAGE.format(" ", " \t\n "), PAGE.format("A title of it", LONG), PAGE.format("1 < 2 and 3 > 2", f"{LONG} a > b, 1 < 2, x <3> y"), PAGE.format("A title", f'<a title="a > b">{LONG}</a>'),
    PAGE.format("A title of it", LONG).replace("</p></article>", "")[:700], PAGE.format("A title", LONG)[:180], PAGE.format("A title", LONG)[:100], f"<p>{LONG}<style>p{{}}", f"<p>{LONG}<nav>menu", PAGE.format("A title", f"{LONG}&am"),
]


@pytest.mark.parametrize("name", ["f17_html_text", "f18_structural_text", "f26_kwic", "p12_needs_render", "p14_choose_extraction", "c3_w17_extract_pages"])
def test_query_agrees_with_sql(spark, tmp_path, name):
    query, sql = pages.QUERIES[name]
    rows = [(k * len(SOURCES) + i, f"https://e.example/{k}/{i}", x) for k in range(3) for i, x in enumerate(SOURCES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in got.columns)
    want = db.sql(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
