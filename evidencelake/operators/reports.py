"""Documents of PDF pages, run summaries, reviews, requests and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .selection import ordered


def normalize_pdf_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (("\r\n?", "\n"), (" ", " "), ("﻿", ""), ("[ \t]+", " "), ("[ \t]*\n[ \t]*", "\n"), ("\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


def assemble_pdf_text(pages: DataFrame) -> DataFrame:
    """doc, text of PDF pages (doc, page_no, text): empty pages go, pages of longer documents get a heading."""
    clean = pages.withColumn("t", normalize_pdf_text(F.col("text")))
    n = F.count("*")
    body = F.filter(ordered(F.struct("page_no", "t"), ["page_no"]), lambda p: p["t"] != "")
    docs = clean.groupBy("doc").agg(n.alias("n_pages"), body.alias("parts"))
    headed = F.transform("parts", lambda p: F.concat(F.lit("## 第 "), p["page_no"], F.lit(" 頁\n\n"), p["t"]))
    plain = F.transform("parts", lambda p: p["t"])
    return docs.select("doc", "n_pages", F.array_join(F.when(F.col("n_pages") > 1, headed).otherwise(plain), "\n\n").alias("text"))


def pdf_page_stats(pages: DataFrame) -> DataFrame:
    """char_count, word_count, printable_ratio and whether a page (text, image_count, has_text_blocks) needs OCR."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    seen = F.regexp_count(t, F.lit(r"(?U)[^\s\p{C}\p{Z}]"))
    out = pages.withColumns({"char_count": F.length(t), "word_count": F.regexp_count(t, F.lit(r"(?U)\S+")), "printable_ratio": F.round(seen / F.greatest(F.length(t), F.lit(1)), 3)})
    c, img = F.col("char_count"), F.col("image_count") > 0
    return out.withColumn("needs_ocr", ((c < 40) & img) | ((c < 20) & ~F.col("has_text_blocks")) | ((F.col("printable_ratio") < 0.15) & img))


def pdf_document_mode(stats: DataFrame) -> DataFrame:
    """text_dominant, scan_dominant or mixed, from the first five pages of each doc."""
    first = stats.filter("page_no <= 5").groupBy("doc").agg(F.avg((F.col("char_count") >= 80).cast("int")).alias("good"), F.avg(((F.col("char_count") <= 20) & (F.col("image_count") > 0)).cast("int")).alias("scan"))
    return first.select("doc", F.when(F.col("good") >= 0.6, "text_dominant").when(F.col("scan") >= 0.8, "scan_dominant").otherwise("mixed").alias("mode"))


def merge_attempts(attempts: DataFrame, counters: list[str], lists: list[str], pages: str | None = None) -> DataFrame:
    """Two or more search attempts (research_id, attempt, success, error, ...) of a research as one: counters summed, lists one after the other.

    ``pages`` names an array of structs; those of attempts after the first get ``from_social_fallback``. The whole succeeds if an
    attempt did and, with ``pages``, there is one. Its error is else that of all attempts, each different one once.
    """
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters]
    joined = [F.flatten(ordered(F.coalesce(F.col(c), F.array()), ["attempt"])).alias(c) for c in lists]
    if pages:
        first = F.min("attempt").over(Window.partitionBy("research_id"))
        names = [f.name for f in attempts.schema[pages].dataType.elementType.fields]
        marked = F.transform(pages, lambda p: F.struct(*(p[n].alias(n) for n in names), F.col("_later").alias("from_social_fallback")))
        attempts = attempts.withColumn("_later", F.col("attempt") > first).withColumn(pages, marked)
        joined.append(F.flatten(ordered(F.col(pages), ["attempt"])).alias(pages))
    ok = F.bool_or("success") & (F.sum(F.size(pages)) > 0) if pages else F.bool_or("success")
    errors = F.array_distinct(ordered(F.trim("error"), ["attempt"]))
    merged = attempts.groupBy("research_id").agg(*sums, *joined, ok.alias("success"), F.array_join(F.filter(errors, lambda e: e != ""), "; ").alias("error"))
    return merged.withColumn("error", F.when(~F.col("success"), F.col("error")))


def run_summary(rounds: DataFrame, counters: list[str]) -> DataFrame:
    """Counters over rounds, rounds done, and the verdict of the last one."""
    return rounds.groupBy("research_id").agg(*(F.sum(c).alias(c) for c in counters), F.count("*").alias("loops_executed"), F.max_by("verdict", "round").alias("last_verdict"))


def chunk_filter_summary(reviews: DataFrame) -> DataFrame:
    """Chunks seen, prompted, selected and discarded, with the detail of each round."""
    detail = ordered(F.struct("round", "prompted", "selected"), ["round"])
    return reviews.groupBy("research_id").agg(F.sum("total").alias("total"), F.sum("prompted").alias("prompted"), F.sum("selected").alias("selected"), (F.sum("prompted") - F.sum("selected")).alias("discarded"), detail.alias("rounds"))


def completion_state(df: DataFrame) -> DataFrame:
    """df: evidence, verdict, failed; complete with evidence that suffices, partial with any, else failed."""
    return df.withColumn("state", F.when(F.col("evidence") <= 0, "failed").when(F.col("verdict") == "sufficient", "complete").otherwise("partial"))


def group_sources(df: DataFrame) -> DataFrame:
    """Sources (title, url) of each query in order; rows without a query go, titles fall back to the URL."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.lit("Untitled"))
    return df.filter(F.coalesce("query", F.lit("")) != "").groupBy("research_id", "query").agg(ordered(F.struct(title.alias("title"), "url"), ["ordinal"]).alias("sources"), F.min("ordinal").alias("first"))


def content_map(pages: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per research and round: search_mode, queries, triggered_by (what the round was for; null for the first), page count and a guide of index, url and title.

    pages: research_id, round, source_ordinal, url, title; rounds: research_id, round, search_mode, queries, reason. A round
    without pages has an empty guide.
    """
    order = F.row_number().over(Window.partitionBy("research_id", "round").orderBy("source_ordinal")) - 1
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    guide = pages.withColumn("index", order).groupBy("research_id", "round").agg(F.count("*").alias("page_count"), ordered(F.struct("index", text("url").alias("url"), text("title").alias("title")), ["index"]).alias("page_guide"))
    both = rounds.join(guide, ["research_id", "round"], "left")
    return both.select(
        "research_id", "round", F.coalesce("search_mode", F.lit("web")).alias("search_mode"), F.coalesce("queries", F.array().cast("array<string>")).alias("queries"),
        F.when(F.col("round") > 1, text("reason")).alias("triggered_by"), F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("page_guide", F.array().cast(guide.schema["page_guide"].dataType)).alias("page_guide"),
    )


def normalize_request(requests: DataFrame) -> DataFrame:
    """Words outside of their lists become the default."""
    allowed = {"search_mode": ("web", "academic", "social"), "mode": ("fast", "instant", "full"), "extraction_mode": ("general", "strict"), "format": ("markdown", "text", "html", "summary")}
    return requests.withColumns({c: F.when(F.lower(F.trim(c)).isin(*words), F.lower(F.trim(c))).otherwise(words[0]) for c, words in allowed.items() if c in requests.columns})


def validate_requests(requests: DataFrame, n_queries: int) -> DataFrame:
    """The first thing that is wrong with a request, as a column, null if nothing is."""
    blank = F.size(F.filter("queries", lambda q: F.trim(F.coalesce(q, F.lit(""))) == "")) > 0
    return requests.withColumn("error", F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "question is empty").when(F.size("queries") != n_queries, "wrong number of queries").when(blank, "a query is empty").when((F.col("min_total") < 1) | (F.col("max_total") < 1), "not positive").when(F.col("min_total") > F.col("max_total"), "min over max"))


def route_turns(turns: DataFrame) -> DataFrame:
    """reuse, direct, research or hybrid for each turn, from the planner's word, force flag, URLs read and evidence at hand."""
    strategy = (
        F.when(F.col("force_research"), "research").when((F.col("strategy") == "direct") & (F.col("pages_read") > 0) & (F.col("verdict") == "sufficient"), "direct")
        .when((F.col("strategy") == "reuse") & (F.col("prior_evidence") > 0) & (F.col("explicit_urls") == 0), "reuse").otherwise("research")
    )
    return turns.withColumn("_s", strategy).withColumn("route", F.when((F.col("_s") == "research") & ((F.col("direct_evidence") > 0) | (F.col("refresh_urls") > 0)), "hybrid").otherwise(F.col("_s"))).drop("_s")


def public_payload(results: DataFrame, fields: dict[str, object]) -> DataFrame:
    """Only the listed fields, with their defaults, as JSON."""
    kept = [F.coalesce(F.col(c), F.lit(default)).alias(c) if c in results.columns else F.lit(default).alias(c) for c, default in fields.items()]
    return results.select("research_id", F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("payload"))


def est_tokens(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("tokens", T.est_tokens(F.col(col)))
