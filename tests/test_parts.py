"""Helpers on Arrow batches turn a few rows at a time into Python objects."""

import pyarrow as pa
from evidencelake.functions import cleanup, markup
from pyspark.sql import functions as F


def test_parts_are_small(monkeypatch):
    alive, most = set(), []

    def read(x):
        alive.add(x)
        most.append(len(alive))
        return x

    made = pa.array

    def array(values, kind=None):
        out = made(values, kind)
        alive.clear()
        return out

    monkeypatch.setattr(cleanup.pa, "array", array)
    values = made([None, *map(str, range(1999))])
    assert cleanup.in_parts(values, read, pa.string()) == values and max(most) == 256
    assert len(cleanup.in_parts(values[:0], read, pa.string())) == 0


def test_pages_and_texts_over_several_parts(spark):
    rows = [(i, f"<h1>Heading number {i}</h1><p>caf&eacute; {i}<a href='/{i}'>x</a>") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, html string").coalesce(1)
    got = df.select("id", markup.page(F.col("html")).alias("p")).select("id", "p.text", "p.h1", F.size("p.links")).collect()
    assert sorted(map(tuple, got)) == [(i, f"Heading number {i}\ncafé {i}\nx", f"Heading number {i}", 1) for i in range(1000)]
    kept = cleanup.sanitize(df.withColumn("html", F.concat(F.lit("ﬁ &amp; "), F.col("id").cast("string"))), "html")
    assert sorted(map(tuple, kept.collect())) == [(i, f"fi & {i}") for i in range(1000)]
