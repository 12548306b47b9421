"""The retention of chunks covers texts without a line in them: null, empty and blank ones."""

import duckdb
import pytest
from evidencelake.operators import chunks as K
from evidencelake.plans import chunks

LONG = "Words of being in a sentence, as they come and go at present. " * 3


def test_texts_without_lines_have_no_median(spark):
    texts = [None, "", "  ", "\n \t\n", "\r\n\r\n", "a", "a\nbbb", "a\n\nbbb\ncc\n", LONG]
    pages = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "research_id long, source_ordinal long, text string")
    got = K.chunk_retention(pages, pages.filter("length(text) >= 80")).orderBy("source_ordinal").select("extracted_chars", "chunk_chars", "n_chunks", "median_line", "retention", "passes").collect()
    none = [(n, 0, 0, None, 0.0, False) for n in (None, 0, 2, 4, 4)]
    assert [tuple(r) for r in got] == [*none, (1, 0, 0, 1, 0.0, False), (5, 0, 0, 1, 0.0, False), (10, 0, 0, 2, 0.0, False), (len(LONG), len(LONG), 1, len(LONG) - 1, 1.0, True)]


@pytest.mark.parametrize("odd", [None, "", "  ", "\n\n \t\n", "\r\n\r\n"])
def test_query_agrees_with_sql(spark, tmp_path, odd):
    query, sql = chunks.QUERIES["g19_chunk_retention"]
    tables = {
        "documents": ([(i, odd if i == 2 else f"{i} {LONG}\nshort\n{LONG.upper()}{i}") for i in range(5)], "doc_id long, text string"),
        "pages": ([(i, f"https://e.example/{i}", "<title>x</title>") for i in range(36)], "page_id long, url string, html string"),
        "benchmark": ([(i, f"What are words of being {i}?") for i in range(4)], "item_id long, text string"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in got.columns)
    want = db.sql(f"SELECT {names} FROM ({sql})").fetchall()
    assert len(want) == 5 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
