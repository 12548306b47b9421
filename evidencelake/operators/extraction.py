"""Pages read in strict and general mode side by side: candidates, trimming, the best of each mode, cleaning, and the choice between the modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleanup
from ..functions import text as T
from ..functions.markup import page
from .pages import better_extraction, noise_penalty
from .trimming import clean_content, postprocess

#: Candidates have more characters than this.
LEAST = 30
#: What the measures of a page look at of its HTML.
HEAD = 5000


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, url, head (start of the HTML), html_len, i, source, text, title of each candidate: the main part (0) and the whole page (1). A page without one has its whole text with i = -1."""
    whole = lambda c: F.length(T.stripped(c)) > LEAST
    row = lambda i, source, text: F.struct(F.lit(i).alias("i"), source.alias("source"), text.alias("text"))
    found = pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, HEAD).alias("head"), F.length("html").alias("html_len"), page(F.col("html")).alias("p"))
    main, all_, fallback = F.col("p.main"), F.col("p.text"), F.lit("html_fallback")
    each = F.filter(F.array(row(0, F.col("p.main_source"), main), row(1, fallback, all_)), lambda c: whole(c["text"]))
    rows = found.withColumn("c", F.explode(F.when(F.size(each) > 0, each).otherwise(F.array(row(-1, fallback, all_)))))
    return rows.select("page_id", "url", "head", "html_len", "c.i", "c.source", F.col("c.text").alias("text"), T.page_title(F.col("p"), F.col("c.text")).alias("title"))


def _measured(rows: DataFrame) -> DataFrame:
    """rows (text, head) with metrics and quality, each a projection of its own."""
    rows = rows.withColumn("_m", F.struct(T.content_metrics(F.col("text"), F.col("head")).alias("metrics"), F.spark_partition_id().alias("task")))
    return rows.withColumn("metrics", F.col("_m.metrics")).drop("_m").withColumn("quality", T.quality_gate(F.col("text"), F.col("metrics")))


def candidate_score(mode: str) -> Column:
    """Of measured candidates: quality less noise, with what the mode adds for source, heading and decision."""
    score, usable = F.col("metrics.quality_score"), F.col("quality.usable")
    bonus = F.when(~usable, -1200).when(F.col("source") != "html_fallback", 120).otherwise(0) - F.when(F.col("quality.acceptable"), 0).otherwise(80)
    headed = F.when(F.col("text").startswith("# "), 120 if mode == "strict" else 60).otherwise(0)
    if mode == "strict":
        bonus = bonus + F.when(usable & (score >= T.profile(F.col("metrics.language_hint"), 4)) & (F.col("source") == "html_fallback"), 40).otherwise(0)
    return score - F.col("noise") + bonus + headed


def attempts(pages: DataFrame) -> DataFrame:
    """The best candidate of each page and mode, cleaned: page_id, url, html_len, modes (general, strict or both), source, title, text, steps, metrics, quality, scope.

    pages: page_id, url, html. What both modes do alike is done once, and a candidate that wins both is one row. The whole is one
    pass over the pages: a page without a candidate goes along with an empty text, and has its own again before it is cleaned.
    """
    none = F.col("i") < 0
    found = candidates(pages).withColumn("whole", F.when(none, F.col("text"))).withColumn("text", F.when(none, "").otherwise(F.col("text")))
    trimmed = postprocess(found, "both")
    scored = _measured(trimmed).withColumn("noise", noise_penalty(F.col("text"), F.col("title")))
    place = F.struct((-F.col("i")).alias("i"), "mode")
    for mode in ("general", "strict"):
        of = F.when(F.col("mode").isin("both", mode), F.struct(candidate_score(mode).alias("score"), place.alias("at")))
        scored = scored.withColumn(mode, F.max(of).over(Window.partitionBy("page_id"))["at"] == place)
    modes = F.filter(F.array(*(F.when(F.col(m) & F.col("mode").isin("both", m), m) for m in ("general", "strict"))), lambda x: x.isNotNull())
    won = scored.withColumn("modes", modes).filter(F.size("modes") > 0)
    own = ["page_id", "url", "head", "html_len", "source", "title", "text", "steps", "modes"]
    whole = {"text": F.when(none, F.col("whole")).otherwise(F.col("text")), "steps": F.when(none, F.array().cast(won.schema["steps"].dataType)).otherwise(F.col("steps"))}
    both = won.withColumns(whole).select(*own).withColumn("before", F.length("text"))
    cleaned = clean_content(cleanup.sanitize(both, "text"))
    step = F.struct(F.lit("pipeline").alias("step"), F.col("before"), F.length("text").alias("after"))
    done = _measured(cleaned.withColumn("steps", F.concat("steps", F.array(step))))
    return done.withColumn("scope", T.content_scope(F.col("text"))).drop("head", "before")


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html_len, mode, source, title, text, steps, metrics, quality, scope of each page in the mode that reads it better.

    pages: page_id (one row each), url, html. A null or empty page has an empty text and the reason EMPTY_CONTENT.
    """
    own = ["source", "title", "text", "steps", "metrics", "quality", "scope"]
    row = F.struct(*own, F.col("quality.usable").alias("usable"), F.col("quality.acceptable").alias("acceptable"), F.col("metrics.text_len").alias("text_len"))
    of = lambda mode: F.first(F.when(F.array_contains("modes", mode), row), ignorenulls=True).alias(mode)
    pair = attempts(pages).groupBy("page_id", "url", "html_len").agg(of("strict"), of("general"))
    pair = pair.withColumn("mode", better_extraction(F.col("strict"), F.col("general")))
    best = pair.withColumn("best", F.when(F.col("mode") == "strict", F.col("strict")).otherwise(F.col("general")))
    return best.select("page_id", "url", "html_len", "mode", *(f"best.{c}" for c in own))
