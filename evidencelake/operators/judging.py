"""Prompts for judges as tables, and replies back into rows; the judge itself is a caller's function or a reply table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies as replies_of
from ..functions import text as T
from .selection import ordered, top_rows

SNIPPET = 300


def url_prompts(serp: DataFrame, questions: DataFrame, queries: DataFrame) -> DataFrame:
    """research_id, prompt: merged results of each query (rank, title, url, content, engine, relevance_score, published_date) under the question."""
    snippet = F.when(F.length("content") > SNIPPET, F.concat(F.substring("content", 1, SNIPPET), F.lit("…"))).otherwise(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit("(無摘要)")))
    meta = F.concat_ws(", ", F.concat(F.lit("來源="), F.nullif(F.col("engine"), F.lit(""))), F.concat(F.lit("相關性="), F.format_string("%.2f", "relevance_score")), F.concat(F.lit("日期="), F.nullif(F.col("published_date"), F.lit(""))))
    line = F.concat(F.format_string("[%d] 標題: %s\n    URL: %s\n    摘要: %s", F.col("rank") - 1, "title", "url", snippet), F.when(meta == "", "").otherwise(F.concat(F.lit("\n    元資料: "), meta)))
    groups = serp.withColumn("line", line).groupBy("research_id", "query_ordinal").agg(F.array_join(ordered(F.col("line"), ["rank"]), "\n").alias("body"))
    headed = groups.join(queries, ["research_id", "query_ordinal"]).withColumn("part", F.format_string("## 第 %d 組搜尋結果（搜尋字詞：%s）\n%s\n", F.col("query_ordinal") + 1, "query", "body"))
    parts = headed.groupBy("research_id").agg(F.array_join(ordered(F.col("part"), ["query_ordinal"]), "\n").alias("parts"))
    return parts.join(questions, "research_id").select("research_id", F.concat(F.lit("## 用戶原始問題\n"), "question", F.lit("\n\n"), "parts").alias("prompt"))


def _sources_text(chunks: DataFrame, name: str, label: Column) -> DataFrame:
    """research_id, name, n: chunks below their source, each source named once, in order."""
    text = lambda c, other="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    own = ["research_id", "source_ordinal", "source_ref"]
    first = lambda c: F.min_by(c, F.struct("round", "chunk_ordinal")).alias(c)
    each = chunks.withColumn("c", F.concat(label, F.lit("\n"), F.coalesce("text", F.lit(""))))
    body = each.groupBy(*own).agg(first("title"), first("source_url"), first("from_query"), F.array_join(ordered(F.col("c"), ["round", "chunk_ordinal"]), "\n\n").alias("body"), F.count("*").alias("n"))
    part = F.format_string("來源 %s: %s\nURL: %s\nFrom query: %s\n%s", "source_ref", text("title", "(untitled)"), text("source_url"), text("from_query"), "body")
    return body.withColumn("part", part).groupBy("research_id").agg(F.array_join(ordered(F.col("part"), ["source_ordinal", "source_ref"]), "\n\n---\n\n").alias(name), F.sum("n").alias("n"))


def chunk_prompts(chunks: DataFrame, sessions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """research_id, n_chunks, prompt: question, round, queries, what the last review missed, evidence chosen before, and the chunks to choose from.

    chunks and prior: research_id, round, source_ordinal, source_ref, chunk_ordinal, chunk_id, title, source_url, from_query,
    text; sessions: research_id, question, queries, round, search_mode, mode, missing. Sections without content are left out; a
    session without chunks has no prompt.
    """
    now = _sources_text(chunks, "now", F.concat(F.lit("["), "chunk_id", F.lit("]"))).withColumnRenamed("n", "n_chunks")
    met = now.join(sessions, "research_id")
    if prior is not None:
        met = met.join(_sources_text(prior, "before", F.concat(F.lit("prior chunk "), "chunk_id")).drop("n"), "research_id", "left")
    listed = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    before = F.col("before") if prior is not None else F.lit(None).cast("string")
    n = F.col("n_chunks").cast("string")
    parts = (
        F.concat(F.lit("## 用戶問題\n"), "question", F.lit("\n")), F.concat(F.lit("## 本輪\n第 "), F.col("round").cast("string"), F.lit(" 輪，搜尋模式："), "search_mode", F.lit("，執行模式："), "mode"), F.concat(F.lit("## 本輪搜尋字詞\n"), listed("queries")),
        F.concat(F.lit("## 上輪指出的缺口\n"), F.nullif(listed("missing"), F.lit(""))), F.concat(F.lit("## 上輪已選證據（只供 sufficiency judge，不需要重新輸出這些 ID）\n"), before),
        F.concat(F.lit("## 本輪可選 chunk（共 "), n, F.lit(" 個，已放入全部 "), n, F.lit(" 個有效 chunk）\n"), "now"),
    )
    return met.select("research_id", "n_chunks", F.concat_ws("\n\n", *parts).alias("prompt"))


def judge(prompts: DataFrame, fn: Callable[[Column], Column] | None = None, replies: DataFrame | None = None) -> DataFrame:
    """prompts with reply: by the caller's (pandas) function of the prompt, or from a table of replies; null where there is none."""
    if fn is not None:
        return prompts.withColumn("reply", fn(F.col("prompt")))
    if replies is None:
        return prompts.withColumn("reply", F.lit(None).cast("string"))
    return prompts.join(replies.select("research_id", "reply"), "research_id", "left")


def parse_url_picks(replies: DataFrame, serp: DataFrame, least: int, most: int) -> DataFrame:
    """research_id, group_index, pick_ordinal, result_index of replies (research_id, reply); where none parses, the first ``least`` results of each group."""
    parsed = replies.select("research_id", replies_of.picks_of(F.col("reply")).alias("s"))
    size = serp.groupBy("research_id", F.col("query_ordinal").alias("group_index")).agg(F.max("rank").alias("n"))
    named = parsed.filter("s is not null").select("research_id", F.posexplode("s").alias("a", "s")).select("research_id", "s.group_index", "a", F.posexplode("s.result_indices").alias("b", "result_index"))
    valid = named.join(size, ["research_id", "group_index"]).filter("result_index >= 0 and result_index < n")
    kept = valid.withColumn("i", F.row_number().over(Window.partitionBy("research_id", "group_index", "a").orderBy("b"))).filter(F.col("i") <= most)
    picks = kept.select("research_id", "group_index", (F.col("a") * 1000 + F.col("b")).alias("pick_ordinal"), "result_index")
    failed = parsed.filter("s is null").select("research_id")
    first = top_rows(serp.join(failed, "research_id", "left_semi"), ["research_id", "query_ordinal"], ["rank"], least)
    return picks.unionByName(first.select("research_id", F.col("query_ordinal").cast("int").alias("group_index"), (F.col("rank") - 1).alias("pick_ordinal"), (F.col("rank") - 1).alias("result_index")))


def parse_chunk_reviews(replies: DataFrame, search_mode: str = "web") -> DataFrame:
    """research_id, parsed, selected_chunk_ids, verdict, gap_analysis, answered, missing, next_search_queries, search_mode of replies (research_id, reply); ids of an unreadable reply are those that its text names, and its verdict is insufficient."""
    d = replies.select("research_id", replies_of.review_of(F.col("reply")).alias("d"))
    mode = F.coalesce("d.search_mode", F.lit(search_mode))
    return d.select(
        "research_id", "d.parsed", F.array_distinct("d.ids").alias("selected_chunk_ids"), "d.verdict", "d.gap_analysis", "d.answered", "d.missing", F.col("d.queries").alias("next_search_queries"),
        F.when(mode.isin("web", "academic", "social"), mode).otherwise("web").alias("search_mode"),
    )


def parse_plans(replies: DataFrame, n_queries: int = 3) -> DataFrame:
    """research_id, standalone_question, strategy, queries, refresh_refs of planner replies (research_id, question, reply).

    reuse needs earlier turns, direct needs URLs in the message, and neither goes with forced research: columns multi_turn and
    has_urls (true where they are missing) and force_research (false) say so. These two have no queries; research has
    ``n_queries``, filled up from the question in its language (column language, English where it is missing).
    """
    given = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in replies.columns else F.lit(other)
    d = replies.select("research_id", F.coalesce("question", F.lit("")).alias("question"), replies_of.plan_of(F.col("reply")).alias("d"), *(given(c, o).alias(c) for c, o in (("multi_turn", True), ("has_urls", True), ("force_research", False), ("language", "en"))))
    word = F.when((F.col("d.strategy") == "reuse") & F.col("multi_turn") & ~F.col("force_research"), "reuse").when((F.col("d.strategy") == "direct") & F.col("has_urls") & ~F.col("force_research"), "direct").otherwise("research")
    in_words = lambda chinese, other: F.when(F.col("language") == "zh-TW", F.lit(chinese)).otherwise(F.lit(other))
    spare = [F.col("question"), *(F.concat("question", in_words(*w)) for w in ((" 最新資料", " latest information"), (" 深度分析", " in-depth analysis")))]

    def filled(queries: Column) -> Column:
        for k in range(n_queries):
            own = spare[k] if k < len(spare) else F.lit(None).cast("string")
            view = F.concat("question", in_words(" 觀點 ", " perspective "), F.lit(str(k + 1)))
            add = F.when(F.array_contains(queries, own), view).otherwise(F.coalesce(own, view))
            queries = F.when(F.size(queries) == k, F.concat(queries, F.array(add))).otherwise(queries)
        return F.slice(queries, 1, n_queries)

    searched = word == "research"
    asked = F.coalesce(F.nullif(F.substring("d.standalone_question", 1, 20_000), F.lit("")), F.col("question"))
    none = F.array().cast("array<string>")
    return d.select("research_id", asked.alias("standalone_question"), word.alias("strategy"), F.when(searched, filled(F.col("d.queries"))).otherwise(none).alias("queries"), F.when(searched, F.col("d.refresh_refs")).otherwise(none).alias("refresh_refs"))


def coerce_queries(requests: DataFrame, n: int = 3) -> DataFrame:
    """requests (research_id, question, search_queries text) with queries: exactly ``n`` from JSON, a list by lines, ``;`` or ``|``, else commas; marks of lists go, repeats in any case go, the question fills up."""
    raw = F.trim(F.coalesce("search_queries", F.lit("")))
    listed = F.from_json(raw, "array<string>")
    by = F.when(raw.rlike(r"[\n;|]"), F.split(raw, r"[\n;|]")).otherwise(F.split(raw, ","))
    items = F.filter(F.transform(F.coalesce(listed, by), lambda q: F.trim(F.regexp_replace(F.trim(q), r"^(?:[-*•]\s*|\d+[.)、]\s*)", ""))), lambda q: q != "")
    whole = F.concat(items, F.array("question", F.concat("question", F.lit(" overview")), F.concat("question", F.lit(" details"))))
    once = T.let(whole, lambda w: F.filter(w, lambda x, i: F.array_position(F.transform(w, lambda y: F.lower(y)), F.lower(x)) == i + 1))
    return requests.withColumn("queries", F.slice(once, 1, n))
