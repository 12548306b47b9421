"""Chunks: paragraphs, splitting, scoring, selection, and evidence with citation marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.urls import canonical_url, citation_id
from .selection import first_by, ordered


def _fold(pieces: Column, most: int) -> Column:
    """Greedy groups of consecutive pieces, joined by a space, that stay within ``most`` characters; a longer piece stays whole.

    The fold over lengths finds where groups start; texts are joined once.
    """

    def starts(p: Column) -> Column:
        """0-based index of the first piece of each group."""
        first = F.struct(F.lit(-1).alias("size"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

        def step(a: Column, n: Column) -> Column:
            fits = (a["size"] >= 0) & (a["size"] + 1 + n <= most)
            return F.struct(F.when(fits, a["size"] + 1 + n).otherwise(n).alias("size"), F.when(fits, a["at"]).otherwise(F.concat(a["at"], F.array(a["i"]))).alias("at"), (a["i"] + 1).alias("i"))

        return F.aggregate(F.transform(p, lambda x: F.length(x)), first, step)["at"]

    def groups(b: Column) -> Column:
        ends = F.concat(F.slice(b["at"], F.lit(2), F.greatest(F.size(b["at"]) - 1, F.lit(0))), F.array(F.size(b["p"])))
        return F.zip_with(b["at"], ends, lambda low, high: F.array_join(F.slice(b["p"], low + 1, high - low), " "))

    found = T.let(pieces, lambda p: F.struct(p.alias("p"), starts(p).alias("at")))
    return T.let(found, lambda b: F.when(F.size(b["p"]) == 0, F.array().cast("array<string>")).otherwise(groups(b)))


def _squeezed(x: Column) -> Column:
    """Runs of spaces and tabs as one space, ends trimmed; only where there is such a run does a pattern run."""
    one = F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, "[ \t]+", " ")).otherwise(x)
    return T.stripped(one)


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, or lines if there is one paragraph at most; squeezed, 80 characters or more."""
    clean = lambda parts: F.filter(F.transform(parts, _squeezed), lambda x: x != "")

    def chosen(t: Column) -> Column:
        lines = clean(F.split(t, T.BREAK))
        blocks = T.let(clean(F.split(t, r"\n{2,}")), lambda b: F.when(F.size(b) > 1, b).otherwise(lines))
        return F.when(F.contains(t, F.lit("\n\n")), blocks).otherwise(lines)

    return F.filter(T.let(F.coalesce(text, F.lit("")), chosen), lambda x: F.length(x) >= C.CHUNK_MIN)


def pdf_paragraphs(text: Column) -> Column:
    """Lines of each page section packed to the target size; a short rest joins the paragraph before it."""
    sections = F.split(F.coalesce(text, F.lit("")), r"(?m)^##\s*第\s*\d+\s*頁\s*$")
    packed = F.flatten(F.transform(sections, lambda s: _fold(T.lines_of(s), C.CHUNK_TARGET)))
    start = F.array().cast("array<string>")
    join = lambda a, p: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(a, -1), p)))
    joined = F.aggregate(packed, start, lambda a, p: F.when((F.length(p) < C.CHUNK_MIN) & (F.size(a) > 0), join(a, p)).otherwise(F.concat(a, F.array(p))))
    return F.filter(joined, lambda x: F.length(x) >= C.CHUNK_MIN)


def dedupe_paragraphs(paras: Column) -> Column:
    """First of the paragraphs that start with the same 220 characters in any case."""
    key = lambda x: F.replace(F.lower(F.substring(x, 1, 220)), F.lit("ß"), F.lit("ss"))
    both = T.let(paras, lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: key(x)).alias("k")))
    alike = lambda b: F.filter(b["p"], lambda x, i: F.array_position(b["k"], F.get(b["k"], i)) == i + 1)
    return T.let(both, lambda b: F.when(F.size(F.array_distinct(b["k"])) == F.size(b["p"]), b["p"]).otherwise(alike(b)))


def split_long(paragraph: Column, most: int = C.CHUNK_MAX) -> Column:
    """A paragraph of over ``most`` characters by sentences and lines, packed again; slices if it is one sentence."""
    pieces = F.filter(F.transform(F.split(paragraph, r"(?<=[。！？.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(paragraph) - 1) / most).cast("int")), lambda k: F.trim(F.substr(paragraph, k * most + 1, F.lit(most))))
    long_ = T.let(pieces, lambda p: F.when(F.size(p) <= 1, slices).otherwise(_fold(p, most)))
    return F.when(F.length(paragraph) <= most, F.array(paragraph)).otherwise(long_)


def chunk_pages(pages: DataFrame, round_: int = 1) -> DataFrame:
    """Chunks of pages (research_id, source_ordinal, url, title, from_query, question, text, resource_type), scored for the question; no shuffle."""
    paras = F.when(F.lower(F.coalesce("resource_type", F.lit("html"))) == "pdf", pdf_paragraphs(F.col("text"))).otherwise(paragraphs(F.col("text")))
    prepared = pages.withColumn("paras", paras).withColumn("paras", dedupe_paragraphs(F.col("paras")))
    prepared = prepared.withColumn("terms", T.review_terms(F.col("question"), F.col("from_query"))).withColumn("parts", F.flatten(F.transform("paras", lambda p: split_long(p))))
    each = prepared.select("research_id", "source_ordinal", "url", "title", "from_query", "terms", F.posexplode("parts").alias("at", "text"))
    return each.select(
        "research_id", F.lit(round_).alias("round"), F.format_string("L%d-S%d", F.lit(round_), F.col("source_ordinal").cast("long")).alias("source_ref"), "source_ordinal", (F.col("at") + 1).alias("chunk_ordinal"),
        T.chunk_id(F.lit(round_), F.col("source_ordinal"), F.col("at") + 1).alias("chunk_id"), F.col("url").alias("source_url"), "title", "from_query", "text", T.chunk_score(F.col("text"), F.col("at"), F.col("terms")).alias("score"),
    )


ORDER = ["source_ordinal", "chunk_ordinal"]


def fallback_chunks(chunks: DataFrame, n: int = C.FALLBACK_CHUNKS) -> DataFrame:
    """Without a judge: the first chunk of each source, then the best scores, n in all."""
    w = Window.partitionBy("research_id")
    first = F.row_number().over(Window.partitionBy("research_id", "source_ref").orderBy(*ORDER)) == 1
    later = F.when(F.col("head"), 0.0).otherwise(-F.col("score"))
    ranked = chunks.withColumn("head", first).withColumn("pick", F.row_number().over(w.orderBy(F.desc("head"), later, *ORDER)))
    return ranked.filter(F.col("pick") <= n).drop("head")


def topk_chunks(chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each research."""
    return chunks.withColumn("pick", F.row_number().over(Window.partitionBy("research_id").orderBy(F.desc("score"), *ORDER))).filter(F.col("pick") <= k)


def valid_selected_ids(reviews: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected ids that are chunks, the first time each is named, in order."""
    named = reviews.select("research_id", F.posexplode("selected_chunk_ids").alias("at", "chunk_id"))
    known = named.join(chunks.select("research_id", "chunk_id").distinct(), ["research_id", "chunk_id"], "left_semi")
    once = first_by(known, ["research_id", "chunk_id"], ["at"])
    return once.withColumn("pick", F.row_number().over(Window.partitionBy("research_id").orderBy("at"))).drop("at")


def evidence_join(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Selected chunks with the first page of their URL, sources numbered in page order, with citation marks.

    pages: research_id, page_order, url, title; chunks: research_id, pick, chunk_id, source_url, text.
    """
    keyed = chunks.withColumn("url_key", canonical_url(F.col("source_url"))).filter("url_key <> ''")
    used = first_by(pages.withColumn("url_key", canonical_url(F.col("url"))), ["research_id", "url_key"], ["page_order"]).join(keyed.select("research_id", "url_key").distinct(), ["research_id", "url_key"], "left_semi")
    numbered = used.withColumn("source_index", F.row_number().over(Window.partitionBy("research_id").orderBy("page_order")))
    mark = F.format_string("[citation](%d:%s)", F.col("source_index"), F.col("citation_id"))
    cited = numbered.withColumn("citation_id", citation_id(F.col("url_key"))).withColumn("citation_marker", mark)
    return keyed.drop("title").join(cited.select("research_id", "url_key", "source_index", "url", "title", "citation_id", "citation_marker"), ["research_id", "url_key"])


def evidence_bundle(joined: DataFrame) -> DataFrame:
    """One row a research: an array of sources with their chunks."""
    source = joined.groupBy("research_id", "source_index", "title", "url", "citation_id", "citation_marker").agg(ordered(F.struct("chunk_id", "text"), ["pick"]).alias("chunks"))
    return source.groupBy("research_id").agg(ordered(F.struct("source_index", "title", "url", "citation_id", "citation_marker", "chunks"), ["source_index"]).alias("evidence"))


def write_evidence(joined: DataFrame, path: str, fmt: str = "parquet") -> None:
    evidence_bundle(joined).write.format(fmt).save(path)


def evidence_pages(joined: DataFrame) -> DataFrame:
    """Pages whose content is their selected chunks."""
    return joined.groupBy("research_id", "source_index", "url", "title").agg(F.array_join(ordered(F.concat(F.lit("["), "chunk_id", F.lit("]\n"), "text"), ["pick"]), "\n\n").alias("content")).withColumn("content_length", F.length("content"))


def chunk_retention(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """How much of each page's text its chunks keep; passes at 20 %."""
    kept = chunks.groupBy("research_id", "source_ordinal").agg(F.sum(F.length("text")).alias("chunk_chars"), F.count("*").alias("n_chunks"))
    sizes = pages.select("research_id", "source_ordinal", F.length("text").alias("extracted_chars"), F.array_sort(F.transform(T.lines_of(F.col("text")), lambda x: F.length(x))).alias("sizes"))
    median = F.get("sizes", F.floor((F.size("sizes") - 1) / 2).cast("int"))  # null where a text has no line
    out = sizes.join(kept, ["research_id", "source_ordinal"], "left").withColumn("median_line", median).drop("sizes")
    ratio = F.coalesce(F.col("chunk_chars"), F.lit(0)) / F.greatest(F.col("extracted_chars"), F.lit(1))
    return out.withColumns({"chunk_chars": F.coalesce("chunk_chars", F.lit(0)), "n_chunks": F.coalesce("n_chunks", F.lit(0)), "retention": ratio}).withColumn("passes", F.col("retention") >= 0.20)
