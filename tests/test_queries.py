import os

import __spark_entry__ as entry
import duckdb
import pytest
from evidencelake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TWINS = {n: q for n, q in plans.registered().items() if q[1]}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_agrees_with_sql(spark, duck, name):
    query, sql = TWINS[name]
    got, want = query(spark, SF), duck.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda columns, data: sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in data), key=repr)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.registered()) - set(TWINS)))
def test_query_without_twin_runs(spark, name):
    assert plans.registered()[name][0](spark, SF).count() > 0


def test_entry(spark):
    assert os.path.isdir(SF)
    assert entry.entry(spark).count() > 0
