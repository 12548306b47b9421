"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing, each over all that the one before kept.

Rows are documents. All stages but the last return the columns of ``documents`` as they are.
doc_id is taken for the name of a document; rows without one are judged like others by quality
rules, exact dedup and mixing, and stay in near-dedup, which decides by name. Rows that repeat
a doc_id and its text are one group of exact copies, of which one row stays. Empty tables pass
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidencelake.llm import exact_dedup, jaccard, mixing, packing, quality
from evidencelake.llm.common import SPACE, materialize

#: Mixing takes nine tenths of the tokens and no document twice.
BUDGET_SHARE, MOST_REPEATS = 0.9, 1.0


def _beside(docs: DataFrame) -> DataFrame:
    """doc_id, text and source beside the whole row, whose column names then cannot clash."""
    own = [F.col(c) for c in ("text", "source")]
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *own)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the likelihood ratio reject."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = quality.log_ratios(quality.bucket_counts(base, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    # the task number, which is not a function of the row, keeps the filter above the scores: pushed
    # below, it would repeat all expressions that they are made of
    scored = quality.score(_beside(docs), ratios).withColumn("task", F.spark_partition_id())
    return scored.filter("kept and task >= 0").select("doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = exact_dedup.exact_dedup(docs).groupBy("doc_id", "digest").agg(F.max("kept").alias("one_stays"), F.count("*").alias("n"))
    # all other rows stay: what is joined is the copies alone
    copies = found.filter("not one_stays or n > 1").select(F.col("doc_id").alias("copy_id"), F.hex("digest").alias("copy_of"), "one_stays")
    body = F.upper(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, "").cast("binary"), 256))
    # what is shuffled holds each text once
    met = _beside(docs).withColumns({"body": body, "n_chars": F.length("text")}).select("doc", "doc_id", "body", "n_chars")
    met = met.join(copies, met["doc_id"].eqNullSafe(copies["copy_id"]) & (met["body"] == copies["copy_of"]), "left")
    single = met.filter("one_stays is null").select("doc.*")
    repeated = met.filter("one_stays").withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "body").orderBy(F.desc("n_chars"))))
    return single.unionByName(repeated.filter("at = 1").select("doc.*"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles: fingerprints within 2 bits, or Jaccard similarity of 0.8 or more) the document with the smallest doc_id."""
    groups = jaccard.near_groups(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    copies = groups.filter("not stays").select(F.col("doc_id").alias("copy_id"))
    met = _beside(docs)
    return met.join(copies, met["doc_id"] == copies["copy_id"], "left_anti").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes."""
    plan = mixing.plan_mix(docs, None, MOST_REPEATS, BUDGET_SHARE)
    return mixing.copies(_beside(docs).drop("text"), plan).filter("copies > 0").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.harmonic_pack(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Hashes, tokens and the likelihood ratio are beyond DuckDB's SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
