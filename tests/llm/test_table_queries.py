"""The queries on vectors and conversations against their SQL twins, with the types that they promise."""

import duckdb
import pytest
from evidencelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op11_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_equals_its_twin(spark, name):
    found = Q.queries()[name](spark, SF)
    kinds = dict(found.dtypes)
    names = [c.split(" ")[0] for c in COLUMNS[name].split(", ")]
    assert all(kinds[c.split(" ")[0]] == c.split(" ")[1] for c in COLUMNS[name].split(", "))
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, want))
