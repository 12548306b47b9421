"""Registered queries, by area."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as K
from ..sources.tables import sessions, table

AREAS = ("serp", "pages", "chunks", "conversations", "providers", "language", "jobs")


def registered() -> dict[str, tuple]:
    """name: (query, SQL twin or None)."""
    return {name: pair for area in AREAS for name, pair in import_module(f"{__name__}.{area}").QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to evidence: text, quality gate, chunks scored for the session's question, selection, citation marks."""
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % sessions(spark, sf_dir)).alias("research_id"), F.col("page_id").alias("source_ordinal"), "url", "html")
    read = pages.withColumns({"text": T.html_to_text(F.col("html")), "title": T.extract_title(F.col("html"))})
    judged = read.withColumn("quality", T.quality_gate(F.col("text"), T.content_metrics(F.col("text"), F.col("html")))).drop("html").filter("quality.usable")
    asked = judged.withColumns({"from_query": F.lit(""), "resource_type": F.lit("html")}).join(table(spark, sf_dir, "questions"), "research_id")
    picked = K.fallback_chunks(K.chunk_pages(asked))
    joined = K.evidence_join(pages.select("research_id", F.col("source_ordinal").alias("page_order"), "url", T.extract_title(F.col("html")).alias("title")), picked)
    return joined.select("research_id", "source_index", "url", "citation_marker", "chunk_id", "text")
