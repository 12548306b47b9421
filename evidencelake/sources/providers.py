"""Archived search responses, one JSON text a query, as result rows; a registry of providers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

ROW = ["research_id", "query_ordinal", "source_ordinal", "position", "title", "url", "content", "engine", "source_engines", "search_lane", "relevance_score", "published_date"]


def clean(text: Column) -> Column:
    """Space of one line squeezed, control and zero-width characters gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u200b-\\u200d\\ufeff]", ""), r"(?U)[\s\p{Cc}]+", " "))


def clean_block(text: Column) -> Column:
    """The same, with line ends kept."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\u200b-\\u200d\\ufeff]", ""), r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[^\S\n]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def _rows(raw: DataFrame, schema: str, path: str, cap: int, fields: dict[str, Column]) -> DataFrame:
    """raw: research_id, query_ordinal, source_ordinal, body. Rows without a URL go; the first ``cap`` stay, numbered from 1."""
    each = raw.withColumn("r", F.from_json("body", schema)).select("research_id", "query_ordinal", "source_ordinal", *[c for c in ("lane",) if c in raw.columns], F.posexplode(path).alias("at", "r"))
    full = {"source_engines": F.array().cast("array<string>"), "search_lane": F.lit(None).cast("string"), "relevance_score": F.lit(None).cast("double"), "published_date": F.lit(None).cast("string")} | fields
    named = each.withColumns({k: v for k, v in full.items()}).filter("url <> ''")
    placed = named.withColumn("position", F.row_number().over(Window.partitionBy("research_id", "query_ordinal", "source_ordinal").orderBy("at")))
    return placed.filter(F.col("position") <= cap).select(*ROW)


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def normalize_searxng(raw: DataFrame) -> DataFrame:
    item = "struct<title:string,url:string,content:string,engine:string,engines:array<string>,score:double,publishedDate:string,published_date:string>"
    engines = F.filter(F.coalesce("r.engines", F.array("r.engine")), lambda e: F.coalesce(e, F.lit("")) != "")
    date = F.coalesce(F.nullif(F.col("r.publishedDate"), F.lit("")), F.col("r.published_date"))
    lane = F.col("lane") if "lane" in raw.columns else F.lit("general")
    return _rows(raw, f"results array<{item}>", "r.results", C.RESULTS_PER_QUERY, {"title": clean(F.col("r.title")), "url": clean(F.col("r.url")), "content": clean_block(F.col("r.content")), "engine": F.lit("searxng"), "source_engines": engines, "search_lane": lane, "relevance_score": F.col("r.score"), "published_date": date})


def normalize_brave(raw: DataFrame) -> DataFrame:
    item = "struct<title:string,url:string,description:string,extra_snippets:array<string>,page_age:string,age:string>"
    parts = F.transform(F.filter(F.concat(F.array("r.description"), F.coalesce("r.extra_snippets", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""), clean_block)
    return _rows(raw, f"web struct<results:array<{item}>>", "r.web.results", C.PROVIDER_CAPS["brave"], {"title": clean(F.col("r.title")), "url": clean(F.col("r.url")), "content": F.array_join(parts, "\n\n"), "engine": F.lit("brave"), "published_date": F.coalesce("r.page_age", "r.age")})


def normalize_tavily(raw: DataFrame) -> DataFrame:
    item = "struct<title:string,url:string,content:string,score:double,published_date:string>"
    return _rows(raw, f"results array<{item}>", "r.results", C.PROVIDER_CAPS["tavily"], {"title": clean(F.col("r.title")), "url": clean(F.col("r.url")), "content": clean_block(F.col("r.content")), "engine": F.lit("tavily"), "relevance_score": F.col("r.score"), "published_date": F.col("r.published_date")})


def normalize_exa(raw: DataFrame) -> DataFrame:
    item = "struct<title:string,url:string,text:string,highlights:array<string>,highlightScores:array<double>,publishedDate:string>"
    lights = F.array_join(F.transform("r.highlights", clean_block), "\n\n")
    scores = F.col("r.highlightScores")
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    return _rows(raw, f"results array<{item}>", "r.results", C.PROVIDER_CAPS["exa"], {"title": clean(F.col("r.title")), "url": clean(F.col("r.url")), "content": F.when(F.size("r.highlights") > 0, lights).otherwise(clean_block(F.substring("r.text", 1, 500))), "engine": F.lit("exa"), "relevance_score": mean, "published_date": F.col("r.publishedDate")})


def _organic(raw: DataFrame, engine: str, content: Column, date: Column) -> DataFrame:
    item = "struct<title:string,link:string,snippet:string,source:string,date:string,publication_info:struct<summary:string>,inline_links:struct<cited_by:struct<total:long>>>"
    return _rows(raw, f"organic_results array<{item}>", "r.organic_results", C.PROVIDER_CAPS[engine], {"title": clean(F.col("r.title")), "url": clean(F.col("r.link")), "content": content, "engine": F.lit(engine), "published_date": date})


def normalize_serp_google(raw: DataFrame) -> DataFrame:
    return _organic(raw, "serpapi_google", clean_block(F.col("r.snippet")), F.col("r.date"))


def normalize_serp_scholar(raw: DataFrame) -> DataFrame:
    summary, snippet, cited = clean(F.col("r.publication_info.summary")), clean_block(F.col("r.snippet")), F.col("r.inline_links.cited_by.total")
    year = F.nullif(F.regexp_extract(F.concat_ws("\n", summary, snippet), r"(?:19|20)\d{2}", 0), F.lit(""))
    return _organic(raw, "serpapi_google_scholar", _joined(summary, snippet, F.when(cited > 0, F.concat(F.lit("Cited by "), cited.cast("string"))).otherwise("")), year)


def normalize_serp_forums(raw: DataFrame) -> DataFrame:
    return _organic(raw, "serpapi_google_forums", _joined(clean(F.col("r.source")), clean_block(F.col("r.snippet"))), F.col("r.date"))


def variant_path(dotted: str) -> str:
    """``$.a[0].b`` of the dotted path ``a.0.b``."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split(".") if p)


def normalize_custom(raw: DataFrame, provider: dict) -> DataFrame:
    """Rows by a declared mapping: ``id``, ``result_path``, ``fields`` (title, url, content, score, published_date) and ``max_results``."""
    fields = {k: k for k in ("title", "url", "content", "score", "published_date")} | (provider.get("fields") or {})
    items = F.try_variant_get(F.try_parse_json("body"), variant_path(provider.get("result_path") or "results"), "array<variant>")
    get = lambda k, kind="string": F.try_variant_get("r.v", variant_path(fields[k]), kind)
    shaped = raw.withColumn("items", F.transform(items, lambda v: F.struct(v.alias("v"))))
    each = shaped.select("research_id", "query_ordinal", "source_ordinal", F.posexplode("items").alias("at", "r"))
    named = each.withColumns({"title": clean(get("title")), "url": clean(get("url")), "content": clean_block(get("content")), "engine": F.lit(provider.get("id") or "custom"), "source_engines": F.array().cast("array<string>"), "search_lane": F.lit("custom"), "relevance_score": get("score", "double"), "published_date": get("published_date")}).filter("url <> ''")
    placed = named.withColumn("position", F.row_number().over(Window.partitionBy("research_id", "query_ordinal", "source_ordinal").orderBy("at")))
    return placed.filter(F.col("position") <= max(1, int(provider.get("max_results") or 100))).select(*ROW)


PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "searxng": normalize_searxng, "brave": normalize_brave, "tavily": normalize_tavily, "exa": normalize_exa,
    "serpapi_google": normalize_serp_google, "serpapi_google_scholar": normalize_serp_scholar, "serpapi_google_forums": normalize_serp_forums,
}


MODES = ("web", "academic", "social")


def custom_providers(custom: list[dict] | None, mode: str | None = None) -> list[dict]:
    """Declared providers that are enabled and serve the mode (null: any), each with an ``id`` and 1 to 100 results."""
    named = [p | {"id": str(p.get("id") or f"custom-{i + 1}").strip()} for i, p in enumerate(custom or [])]
    used = [p for p in named if p["id"] and p.get("enabled", True) and (mode is None or mode in p.get("modes", MODES))]
    return [p | {"max_results": min(max(1, int(p.get("max_results") or p.get("per_query") or 100)), 100)} for p in used]


def read_serp(raw: DataFrame, custom: list[dict] | None = None, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None, mode: str | None = None, engines: str | None = None) -> DataFrame:
    """Result rows of archived responses (provider, research_id, query_ordinal, source_ordinal, body) of all providers.

    ``extra`` adds or replaces providers; ``custom`` declares mapped ones, of which those count that are enabled and
    serve ``mode``. ``engines`` chooses one side: ``searxng`` is the own engine alone, ``custom`` all others.
    """
    own = {k: f for k, f in (PROVIDERS | (extra or {})).items() if engines is None or (k == "searxng") == (engines == "searxng")}
    parts = [f(raw.filter(F.col("provider") == name)) for name, f in own.items()]
    parts += [normalize_custom(raw.filter(F.col("provider") == p["id"]), p) for p in (custom_providers(custom, mode) if engines != "searxng" else [])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flatten_threads(raw: DataFrame, most: int = 50) -> DataFrame:
    """thread_key, title, text of archived discussion threads (thread_key, body with two listings): header, post, and up to ``most`` top comments; texts of under 50 characters are left out."""
    post = "struct<title:string,author:string,score:long,upvote_ratio:double,num_comments:long,subreddit:string,selftext:string,body:string>"
    listing = f"array<struct<data:struct<children:array<struct<kind:string,data:{post}>>>>>"
    d = raw.withColumn("l", F.from_json("body", listing)).withColumn("p", F.try_element_at(F.try_element_at("l", F.lit(1))["data"]["children"], F.lit(1))["data"])
    spoken = F.slice(F.filter(F.try_element_at("l", F.lit(2))["data"]["children"], lambda c: (c["kind"] == "t1") & ~F.coalesce(c["data"]["body"], F.lit("")).isin("", "[deleted]", "[removed]")), 1, most)
    who = lambda a: F.coalesce(a, F.lit("[deleted]"))
    head = F.format_string("**r/%s** | u/%s | Score: %d (%.0f%% upvoted) | %d comments", F.coalesce("p.subreddit", F.lit("")), who(F.col("p.author")), F.coalesce("p.score", F.lit(0)), F.coalesce("p.upvote_ratio", F.lit(0.0)) * 100, F.coalesce("p.num_comments", F.lit(0)))
    lines = F.transform(spoken, lambda c: F.concat(F.format_string("**u/%s** (Score: %d):\n", who(c["data"]["author"]), F.coalesce(c["data"]["score"], F.lit(0))), c["data"]["body"]))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("p.title", F.lit(""))), head, F.nullif(F.concat(F.lit("\n"), F.coalesce("p.selftext", F.lit(""))), F.lit("\n")), F.when(F.size(lines) > 0, F.concat(F.lit("\n---\n## Comments\n\n"), F.array_join(lines, "\n\n"))))
    out = d.select("thread_key", clean(F.col("p.title")).alias("title"), clean_block(body).alias("text"))
    return out.filter(F.length("text") >= 50)
