"""Registered queries of the training-data operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, langid, mixing, packing, prefix_trie, quality, secrets, simhash, suffix_dedup, tokens, topk, toxicity
from .common import id_text
from .vectors import divisible


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(_documents(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def _held_out(folds: int, fold: int) -> Column:
    """Whether a document is in the fold; one without a doc_id is in none."""
    return F.coalesce(F.pmod(id_text(F.col("doc_id")), F.lit(folds)) == fold, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = _held_out(3, 1)
    model = langid.fit(docs.filter(~held))
    return langid.predict(docs, model).withColumn("held_out", held)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_documents(spark, sf_dir)).drop("spans")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_documents(spark, sf_dir))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = _held_out(5, 0)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held))
    return toxicity.score(docs, model).withColumn("held_out", held)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_documents(spark, sf_dir))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), divisible(F.col("vec_id"), 100))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), prefix_trie.shared_heads)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(divisible(F.col("vec_id"), 7), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, divisible(F.col("vec_id"), 50))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    op1_quality_rules,
    op2_harmonic_packing,
    op3_simhash_dedup,
    op4_language_id,
    op5_suffix_dedup,
    op6_secret_scan,
    op7_exact_dedup,
    op8_temperature_mixing,
    op9_toxicity,
    op10_token_counts,
    op11_exact_topk,
    op12_prefix_trie,
    op13_hard_negatives,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body ORDER BY n_chars DESC, doc_id)
"""


_VECTORS = """
WITH finite AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
"""

OP11_SQL = _VECTORS.format(scale=1024) + """
, pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, list_dot_product(q.v, c.v)::BIGINT AS score FROM finite q JOIN finite c ON q.row <> c.row AND q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) QUALIFY rank <= 10
"""

#: CRC-32 bit by bit, as DuckDB has no function for it.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({id}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP12_SQL = f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS i, role, text
             FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))
, conv AS (SELECT conv_id, {_CRC32.format(id="conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own))
, rebuilt AS (SELECT c.conv_id, 0 AS part, i, role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= c.h
              UNION ALL SELECT c.conv_id, 1, i, role, text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h)
, turns AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS path, length(text) AS n
            FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i))
, member AS (SELECT * FROM turns UNION ALL SELECT conv_id, 0, '', 0 FROM conv)
, within AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM member)
, node AS (SELECT path, any_value(depth) AS depth, any_value(up) AS up, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
                  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM within GROUP BY path)
, kids AS (SELECT up AS path, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up)
, full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path))
, below AS (SELECT DISTINCT a.path AS top, b.path FROM within a JOIN within b ON a.conv_id = b.conv_id AND b.depth >= a.depth)
, sums AS (SELECT top AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved_tokens FROM below JOIN full_node USING (path) GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(f.ended) AS ends_sha256
FROM full_node f JOIN sums s USING (path) LEFT JOIN node p ON p.path = f.up
"""

OP13_SQL = _VECTORS.format(scale=256) + """
, moved AS (SELECT row, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM finite WHERE label IS NOT NULL)
, pairs AS (SELECT a.row, a.vec_id AS anchor_id, c.row AS other, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
            FROM moved a JOIN moved c ON a.row <> c.row AND a.vec_id % 50 = 0)
, near AS (SELECT row, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
           QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) <= 5)
SELECT n.anchor_id, n.positive_id, (row_number() OVER w)::INTEGER AS rank, p.vec_id AS negative_id, n.positive_score, p.score AS negative_score
FROM near n JOIN pairs p ON p.row = n.row AND NOT p.same AND 50 * n.positive_score <= 100 * p.score AND 100 * p.score <= 95 * n.positive_score
WINDOW w AS (PARTITION BY n.row, n.other ORDER BY p.score DESC, p.vec_id NULLS LAST, p.other) QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op11_exact_topk": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_hard_negatives": OP13_SQL}
