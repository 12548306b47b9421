"""The registered queries themselves: columns, types, rows, and what their digest columns are derived from."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from evidencelake.llm import queries as Q
from pyspark.sql import functions as F

from tests.llm.conftest import docs_of

COLUMNS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_harmonic_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, shares_passage boolean",
    "op6_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op8_temperature_mixing": "doc_id bigint",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.fixture(scope="module")
def tables(spark, odd_rows, tmp_path_factory):
    """A folder with documents, null ids among them, and labels."""
    at = tmp_path_factory.mktemp("sf")
    docs_of(spark, odd_rows).repartition(2).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(20, 60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, tables, odd_rows, name):
    found = Q.queries()[name](spark, tables)
    kinds = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split(" ")
        assert kinds[c] == kind
    rows = found.collect()
    if name not in ("op2_harmonic_packing", "op8_temperature_mixing"):
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows)
    if "held_out" in kinds:
        folds, fold = (3, 1) if name.startswith("op4") else (5, 0)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in rows)
    if name == "op3_simhash_dedup":
        assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in rows)
        for r in rows:  # components by comparing all pairs
            near = {r["doc_id"]}
            while more := {y["doc_id"] for x in rows if x["doc_id"] in near for y in rows if bin(int(x["fingerprint"], 16) ^ int(y["fingerprint"], 16)).count("1") <= 2} - near:
                near |= more
            assert r["component_id"] == min(i for i in near if i is not None)
    if name == "op5_suffix_dedup":
        texts = {str(i): (t or "").encode() for i, t, *_ in odd_rows}
        assert all(r["n_bytes"] == len(texts[str(r["doc_id"])]) for r in rows)
        assert all(r["kept_sha256"] == hashlib.sha256(texts[str(r["doc_id"])]).hexdigest() for r in rows if not r["n_removed"])
    if name == "op2_harmonic_packing":
        ends = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= 4096


def test_scores_of_queries_hold_out_of_sample(spark):
    at = str(Path("/root/testdata/sf0.01"))
    labels = spark.read.parquet(f"{at}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = Q.op9_toxicity(spark, at).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    assert (score[toxic == 1].mean() - score[toxic == 0].mean() > 0.5) if toxic.any() else True
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
