"""Pages: extraction, links, keyword contexts, attempts, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.markup import page
from ..functions.urls import PARTS_ALL, canonical_url, resolve_url
from ..sources.tables import written
from .keywords import keyword_probe
from .selection import first_by, ordered, top_rows


def extract_pages(pages: DataFrame) -> DataFrame:
    """Best text of each page of the whole-page and the structural candidate, with title, metrics, decision and scope.

    The candidates' score is quality less noise, with a bonus for structural sources; the first wins ties.
    """
    two = pages.withColumns({"s": T.structural_text(F.col("html")), "whole": T.html_to_text(F.col("html"))})
    cands = F.array(F.struct(F.lit(0).alias("i"), F.col("s.source").alias("source"), F.col("s.text").alias("text")), F.struct(F.lit(1).alias("i"), F.lit("html_fallback").alias("source"), F.col("whole").alias("text")))
    each = two.select("page_id", "url", "html", F.explode(cands).alias("c")).select("page_id", "url", F.col("c.*"), T.extract_title(F.col("html"), F.col("c.text")).alias("title"), "html")
    each = each.withColumn("metrics", T.content_metrics(F.col("text"), F.col("html"))).withColumn("quality", T.quality_gate(F.col("text"), F.col("metrics")))
    bonus = F.when(~F.col("quality.usable"), -1200).when(F.col("source") != "html_fallback", 120).otherwise(0) - F.when(F.col("quality.acceptable"), 0).otherwise(80)
    scored = each.withColumn("score", F.col("metrics.quality_score") - noise_penalty(F.col("text"), F.col("title")) + bonus)
    best = top_rows(scored, ["page_id"], [F.desc("score"), "i"], 1)
    return best.select("page_id", "url", "title", "source", "text", "metrics", "quality", T.content_scope(F.col("text")).alias("scope"), F.length("html").alias("html_len"))


LEADING_UI = C.LEADING_UI
TRAILING = C.TRAILING


def noise_penalty(text: Column, title: Column) -> Column:
    """Interface words in the first ten lines, section words in the last twenty, breadcrumbs, a bare title line, and a head of short lines."""

    def parts(lines: Column) -> Column:
        head = F.array_join(F.slice(lines, 1, 10), "\n")
        tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - 19, F.lit(1)), F.lit(20)), "\n")
        return F.struct(head.alias("head"), tail.alias("tail"), F.get(lines, F.lit(0)).alias("first"), F.size(F.filter(F.slice(lines, 1, 6), lambda x: F.length(x) <= 24)).alias("short"))

    def total(b: Column) -> Column:
        return F.when(b["first"].isNull(), 0).otherwise(
            F.least(T.count_marks(b["head"], C.LEADING_UI) * 220, F.lit(1320)) + F.least(T.count_marks(b["tail"], C.TRAILING) * 280, F.lit(1120)) + F.least(T.count(b["head"], r"(?:^|\n)\s*[-|>/]+\s*") * 120, F.lit(360))
            + F.when(~b["first"].startswith("#") & (F.lower(b["first"]) == F.lower(F.trim(title))), 120).otherwise(0) + F.when(b["short"] >= 4, 260).otherwise(0)
        )

    return T.let(T.let(T.lines_of(text), parts), total)


def choose_attempt(attempts: DataFrame) -> DataFrame:
    """For each url_key the rendered attempt where it is the better one, by ordered rules, else the static one.

    attempts: url_key, kind (http, js), fetch_success, status_code, usable, acceptable, scope, text_len, score.
    """
    http, js = (attempts.filter(F.col("kind") == k).select("url_key", F.struct("fetch_success", "status_code", "usable", "acceptable", "scope", "text_len", "score").alias(k)) for k in ("http", "js"))
    h, j, rich = F.col("http"), F.col("js"), "article_plus_comments"
    longer = (j["text_len"] >= C.SUCCESS_MIN) & (j["text_len"] >= F.greatest(F.lit(180), F.floor(h["text_len"] * 1.2)))
    better = ~h["usable"] | F.coalesce(h["status_code"] >= 400, F.lit(False)) | ((j["scope"] == rich) & (h["scope"] != rich)) | longer | (j["score"] >= h["score"] + 150) | (~h["acceptable"] & j["acceptable"])
    chosen = F.when(h.isNull() | (F.coalesce(j["fetch_success"] & j["usable"] & better, F.lit(False))), "js").otherwise("http")
    return http.join(js, "url_key", "full").select("url_key", chosen.alias("chosen"))


def better_extraction(strict: Column, general: Column) -> Column:
    """strict or general of two structs with usable, acceptable and text_len, either of which may be null: strict if it is acceptable, else general if that is acceptable, alone usable, or far longer."""
    longer = strict["usable"] & general["usable"] & (general["text_len"] >= F.greatest(F.lit(240), F.floor(strict["text_len"] * 1.45)))
    return (
        F.when(strict.isNull(), "general").when(general.isNull() | strict["acceptable"], "strict").when(general["acceptable"] | (general["usable"] & ~strict["usable"]) | longer, "general").otherwise("strict")
    )


def choose_extraction(attempts: DataFrame) -> DataFrame:
    """Strict or general extraction of each url_key, by ``better_extraction``. attempts: url_key, mode, usable, acceptable, text_len."""
    s, g = (attempts.filter(F.col("mode") == m).select("url_key", F.struct("usable", "acceptable", "text_len").alias(m)) for m in ("strict", "general"))
    return s.join(g, "url_key", "full").select("url_key", better_extraction(F.col("strict"), F.col("general")).alias("chosen"))


def classify_errors(log: DataFrame) -> DataFrame:
    """page_id, error class by the message, label of the error code (log: page_id, message, error_code, status_code), whether a retry may help."""
    return log.select("page_id", T.error_class(F.col("message")).alias("error_class"), T.error_label(F.col("error_code")).alias("error_label"), F.coalesce(F.col("status_code").isin(*C.RETRY_STATUS), F.lit(False)).alias("retryable"))


def extract_links(pages: DataFrame, n: int) -> DataFrame:
    """page_id, ordinal, link, anchor: the first n distinct http(s) links of each page, resolved against its URL; those that differ in their fragment are distinct."""
    each = pages.select("page_id", "url", F.posexplode(page(F.col("html"))["links"]).alias("at", "a"))
    rows = each.select("page_id", "at", resolve_url(F.col("url"), F.col("a.href")).alias("link"), F.col("a.anchor").alias("anchor")).filter(F.col("link").rlike("^https?://"))
    first = top_rows(rows, ["page_id", "link"], ["at"], 1)
    return first.withColumn("ordinal", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).filter(F.col("ordinal") <= n).drop("at")


def site_map(pages: DataFrame, n: int) -> DataFrame:
    """The first n links of each page that stay on its site."""
    site = lambda c: F.lower(F.regexp_extract(c, PARTS_ALL, 2))
    links = extract_links(pages, 2 * n).join(pages.select("page_id", "url"), "page_id")
    return top_rows(links.filter(site("link") == site("url")), ["page_id"], ["ordinal"], n).drop("url")


def kwic(text: Column, keyword: Column, context: int = 40, most: int = 3) -> Column:
    """Up to ``most`` distinct snippets around the keyword's occurrences from left to right, ends marked by dots."""
    lowered, word = F.lower(text), F.lower(keyword)
    gaps = F.transform(F.split(lowered, F.concat(F.lit("\\Q"), word, F.lit("\\E"))), F.length)

    def snippet(p: Column) -> Column:
        left = F.greatest(p - context, F.lit(0))
        right = F.least(p + F.length(word) + context, F.length(text))
        return F.concat(F.when(left > 0, "...").otherwise(""), F.substr(text, left + 1, right - left), F.when(right < F.length(text), "...").otherwise(""))

    def step(a: Column, gap: Column) -> Column:
        start = a["p"] + gap
        new = F.array(snippet(start))
        out = F.when(F.size(a["out"]) >= most, a["out"]).otherwise(F.array_union(a["out"], new))
        return F.struct((start + F.length(word)).alias("p"), out.alias("out"))

    none = F.array().cast("array<string>")
    before = F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))  # the text after the last occurrence starts none
    return F.when(F.size(gaps) > 1, F.aggregate(before, F.struct(F.lit(0).alias("p"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)


def site_probe(pages: DataFrame, seeds: DataFrame, keywords: DataFrame, n: int = 20) -> DataFrame:
    """Keyword contexts on each seed page and on the first pages of its site that it links to, ``n`` pages a seed.

    pages: page_id, url, html of the archive; seeds: page_id; keywords: ordinal, keyword. One row a seed and page:
    seed_id, ordinal (0: the seed), url_key, page_id (null: not archived), ok (its text is usable) and snippets, at
    most four distinct ones, keywords in order. A page that many seeds link to is read once.
    """
    own = pages.join(seeds.select("page_id").distinct(), "page_id", "left_semi")
    linked = site_map(own, 2 * n).select(F.col("page_id").alias("seed_id"), "ordinal", F.col("link").alias("url"))
    first = own.select(F.col("page_id").alias("seed_id"), F.lit(0).alias("ordinal"), "url").unionByName(linked)
    keyed = first.select("seed_id", "ordinal", canonical_url(F.col("url")).alias("url_key")).filter("url_key <> ''")
    wanted = first_by(keyed, ["seed_id", "url_key"], ["ordinal"], n, ["seed_id"])
    archive = first_by(pages.withColumn("url_key", canonical_url(F.col("url"))), ["url_key"], ["page_id"])
    from .extraction import read_pages  # which is built on this module

    read = read_pages(archive.join(wanted.select("url_key").distinct(), "url_key", "left_semi").select("page_id", "url", "html"))
    # hits and states both need them, and pages are dear to read
    texts = written(read.select("page_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality.usable").alias("usable")), "probed")
    hits = keyword_probe(texts.filter("usable").select("page_id", "text"), keywords).join(keywords, "keyword")
    found = hits.groupBy("page_id").agg(F.slice(F.array_distinct(F.flatten(ordered(kwic(F.col("text"), F.col("keyword"), 45, 2), ["ordinal", "keyword"]))), 1, 4).alias("snippets"))
    known = archive.select("url_key", "page_id").join(texts.select("page_id", "usable"), "page_id")
    rows = wanted.join(known, "url_key", "left").join(found, "page_id", "left")
    return rows.select("seed_id", "ordinal", "url_key", "page_id", F.coalesce("usable", F.lit(False)).alias("ok"), F.coalesce("snippets", F.array().cast("array<string>")).alias("snippets"))


def probe_stats(probe: DataFrame) -> DataFrame:
    """Per seed of a site probe: pages read, pages that could not be, and pages with a snippet."""
    return probe.groupBy("seed_id").agg(F.count_if("ok").alias("pages_scanned"), F.count_if(~F.col("ok")).alias("pages_failed"), F.count_if(F.size("snippets") > 0).alias("matches_found"))


def crawl_stats(log: DataFrame) -> DataFrame:
    ok = F.col("success")
    return log.groupBy("research_id").agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("used_render") == "js")).alias("used_js"), F.count_if(ok & (F.col("resource_type") == "pdf")).alias("used_pdf"))


def needs_social_fallback(summary: DataFrame, least: int = 6) -> DataFrame:
    """summary: research_id, pages, selected."""
    p, s = F.col("pages"), F.col("selected")
    return summary.withColumn("fallback", (p < least) | ((s >= least) & (p < F.greatest(F.lit(2), F.floor(s / 2)))))


def summarize_pages(pages: DataFrame, limit: int = 6000) -> DataFrame:
    """page_id, blocks, summary of each page (page_id, title, text; one row each) with a block: the four best blocks in their order under the title, links stripped. A page is one row throughout, so no text is shuffled."""
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")

    def score(b: Column) -> Column:
        return F.when(F.length(b) < 30, -10.0).otherwise(
            F.least(F.length(b), F.lit(700)) + F.least((F.length(b) - F.length(F.translate(b, ".!?。！？", ""))) * 45, F.lit(360)) + F.least(F.regexp_count(b, F.lit(r"(?U)\d")) * 12, F.lit(120)) + F.when(b.startswith("#"), 180).otherwise(0)
            - F.least(T.nav_hits(b, 500) * 140, F.lit(560)) - F.least(F.when(b.contains("]("), F.regexp_count(b, F.lit(r"\[[^\]]+\]\([^)]*\)"))).otherwise(0) * 70, F.lit(350))
        )

    def summary(p: Column) -> Column:
        best = F.slice(F.array_sort(F.transform(p["b"], lambda b, i: F.struct((-score(b)).alias("s"), i.alias("i")))), 1, 4)
        body = F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: x["i"])), lambda i: F.get(p["b"], i)), "\n\n")
        return F.when(F.trim(p["t"]) != "", F.concat(F.lit("# "), F.trim(p["t"]), F.lit("\n\n"), body)).otherwise(body)

    split = pages.select("page_id", F.struct(F.col("title").alias("t"), blocks.alias("b"), F.spark_partition_id().alias("task")).alias("p")).filter(F.size("p.b") > 0)
    cut = T.let(T.let(F.col("p"), lambda p: T.strip_md_links(summary(p))), lambda t: T.smart_truncate(t, limit))
    return split.select("page_id", F.size("p.b").cast("long").alias("blocks"), cut.alias("summary"))


def evidence_key(col: str = "url") -> Column:
    return canonical_url(F.col(col))
