"""Boilerplate trimming of page texts in steps, and statistics of the steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T

SENTENCE = "[.!?。！？]"


MARKS = "[。！？.!?]"
KANJI = "[一-鿿]"


def occurrences(text: Column, words: Column, reach: Column) -> Column:
    """Array of k (which word) and p (characters before it) for each occurrence of the words that starts at ``reach`` or before, left to right and without overlap."""

    def places(word: Column, k: Column) -> Column:
        gaps = F.transform(F.split(F.substr(text, F.lit(1), reach + F.length(word)), F.concat(F.lit("\\Q"), word, F.lit("\\E"))), F.length)
        before = F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
        found = F.aggregate(before, start, lambda a, g: F.struct((a["end"] + g + F.length(word)).alias("end"), F.concat(a["at"], F.array(a["end"] + g)).alias("at")), lambda a: a["at"])
        return F.transform(found, lambda p: F.struct(k.alias("k"), p.alias("p")))

    return F.flatten(F.transform(words, places))


def _from_anchor(text: Column, words: Column, reach, score, more) -> Column:
    """The text from the occurrence with the greatest positive score on; the first of equal ones. ``score`` goes by the place alone and is taken once for each, ``more`` (words, occurrences, one of them) adds to it by the word."""

    def cut(b: Column) -> Column:
        found = occurrences(b["t"], b["w"], reach(F.length(b["t"])))

        def rate(o: Column) -> Column:
            at = F.array_distinct(F.filter(F.transform(o, lambda x: x["p"]), lambda p: p > 0))
            base = F.map_from_arrays(at, F.transform(at, lambda p: score(b["t"], F.struct(p.alias("p")))))
            each = lambda m: F.transform(F.filter(o, lambda x: x["p"] > 0), lambda x: F.struct((F.element_at(m, x["p"]) + more(b["w"], o, x)).cast("long").alias("s"), (-x["k"]).alias("k"), (-x["p"]).alias("p")))
            return T.let(base, each)

        rated = T.let(found, rate)
        best = F.array_max(F.filter(rated, lambda x: x["s"] > 0))
        return T.let(best, lambda x: F.when(x.isNull(), b["t"]).otherwise(T.stripped(F.substr(b["t"], 1 - x["p"], F.length(b["t"])))))

    return T.let(F.struct(T.stripped(F.coalesce(text, F.lit(""))).alias("t"), words.alias("w")), cut)


def title_starts(title: Column) -> Column:
    """A title, its parts before `` | `` and `` - ``, and the first 64, 48, 36, 24 and 20 characters of each, of 12 characters or more."""
    name = T.stripped(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    parts = (name, F.regexp_replace(name, r"\s+\|\s*-\s+.*$", ""), F.split(name, r"\s+\|\s+", 2)[0], F.split(name, r"\s+-\s+", 2)[0])
    bases = F.array_distinct(F.filter(F.transform(F.array(*parts), lambda x: F.rtrim(T.stripped(x), F.lit(" -|:;,/"))), lambda x: F.length(x) >= 12))
    sizes = lambda b: F.array(b, *(F.when(F.length(b) >= n, F.rtrim(F.substring(b, 1, n), F.lit(" -|:;,."))) for n in (64, 48, 36, 24, 20)))
    return F.array_distinct(F.filter(F.flatten(F.transform(bases, sizes)), lambda x: F.length(x) >= 12))


def title_anchor(text: Column, title: Column) -> Column:
    """The text from the title on, where what stands before it looks like a page's shell."""

    def score(t: Column, x: Column) -> Column:
        def rate(lines: Column) -> Column:
            tail = lambda n: F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))
            marks = T.let(F.array_join(tail(12), "\n"), lambda near: F.struct(T.count_marks(near, C.LEADING_UI).alias("ui"), T.nav_hits(near).alias("nav"), T.count(near, r"(?:^|\n)\s*[-|>/]+\s*").alias("crumbs")))
            short = F.size(F.filter(tail(8), lambda v: F.length(v) <= 24))
            head = F.coalesce(F.get(lines, F.lit(0)), F.lit("")).startswith("#")

            def total(m: Column) -> Column:
                far = F.when(x["p"] >= 60, 240).when((x["p"] >= 8) & ((m["ui"] + m["nav"] + m["crumbs"] > 0) | (short >= 3)), 180).otherwise(0)
                return far + m["ui"] * 140 + m["nav"] * 120 + m["crumbs"] * 140 + F.least(short * 45, F.lit(225)) - F.when(head, 160).otherwise(0)

            return T.let(marks, total)

        return T.let(T.lines_of(F.substr(t, F.lit(1), x["p"])), rate)

    def again(_: Column, all_: Column, x: Column) -> Column:
        return F.when(F.exists(all_, lambda y: (y["k"] == x["k"]) & (y["p"] > x["p"])), 180).otherwise(0)

    return _from_anchor(text, title_starts(title), lambda n: F.least(F.lit(2500), F.greatest(F.lit(600), F.floor(n * 0.35).cast("int"))), score, again)


def heading_anchor(text: Column) -> Column:
    """The text from its first heading on, if 80 characters or more stand before it and it starts within the first 2500."""
    before = F.length(F.split(F.substring(text, 1, 2500), r"(?U)(?=#{1,3}\s+\S)(?<!\w)", 2)[0])
    return T.let(before, lambda n: F.when((n >= 80) & (n < F.least(F.length(text), F.lit(2500))), F.substr(text, n + 1, F.length(text))).otherwise(text))


def shell_line(x: Column) -> Column:
    """Interface words, footnote marks, and short lines without a sentence."""
    words = x.rlike(f"(?s){KANJI}.*{KANJI}") | x.rlike("[A-Za-z]{2,}")
    short = (F.length(x) <= 18) & ~x.rlike(MARKS) & ~x.contains("http://") & ~x.contains("https://") & (x.rlike(f"(?i){T.NAV_SCAN}") | (words & ~x.rlike(r"(?U)\d{2,}")))
    return (x != "") & (x.rlike(C.FOOTNOTE_LINE) | x.rlike(f"(?i){T.SHELL_SCAN}") | x.contains("另開新視窗") | x.isin("小", "中", "大") | short)


def prose_line(x: Column) -> Column:
    han, words, stop = F.regexp_count(x, F.lit(KANJI)), F.regexp_count(x, F.lit("[A-Za-z]{3,}")), x.rlike("[。！？.!?；;：:]")
    told = ((han >= 16) & (stop | (F.regexp_count(x, F.lit(C.CONNECTIVE)) >= 4))) | ((words >= 10) & stop)
    return (F.length(x) >= 32) & ~x.rlike(f"(?i){T.SHELL_SCAN}") & ~x.rlike(r"(?U)^[#\[\](){}<>|/:：\-_=*.\s]+$") & F.when(x.contains("http://") | x.contains("https://"), F.length(x) >= 80).otherwise(told)


def heading_line(x: Column) -> Column:
    fits = lambda bare: (bare != "") & (F.length(bare) <= 36) & ~bare.rlike("https?://") & ~bare.rlike(MARKS) & (bare.rlike(f"(?s){KANJI}.*{KANJI}") | bare.rlike("[A-Za-z]{2,}"))
    return T.let(T.stripped(F.regexp_replace(x, "^#+", "")), fits)


def trim_shell(text: Column) -> Column:
    """Of texts of 12 lines or more whose first 80 hold six shell lines: what precedes the first line of prose, and up to three headings before it, goes if that is eight lines or more. A leading heading stays."""

    def kept(lines: Column) -> Column:
        head = F.when(F.get(lines, F.lit(0)).startswith("#"), 1).otherwise(0)

        def body(b: Column) -> Column:
            shells = F.size(F.filter(F.slice(b, 1, 80), shell_line))
            first = F.array_min(F.filter(F.transform(F.slice(b, 1, 180), lambda x, i: F.when(prose_line(x), i)), lambda i: i.isNotNull()))

            def start(p: Column) -> Column:
                titles = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.coalesce((p >= n) & heading_line(F.get(b, F.greatest(p - n, F.lit(0)))), F.lit(False)))
                return T.let(titles, lambda t: p - F.when(t[0] & t[1] & t[2], 3).when(t[0] & t[1], 2).when(t[0], 1).otherwise(0))

            at = T.let(first, start)
            return T.let(at, lambda p: F.when((shells >= 6) & (p >= 8), F.slice(b, p + 1, F.greatest(F.size(b) - p, F.lit(0)))).otherwise(b))

        rest = F.slice(lines, head + 1, F.greatest(F.size(lines) - head, F.lit(0)))
        return F.when(F.size(lines) < 12, T.stripped(text)).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), head), T.let(rest, body)), "\n"))

    return T.let(T.lines_of(text), kept)


def trim_sections(text: Column) -> Column:
    """Texts of 12 lines or more end before the first closing section after 18 % of the lines, four at least."""

    def kept(lines: Column) -> Column:
        least = F.greatest(F.lit(4), F.floor(F.size(lines) * 0.18).cast("int"))
        cut = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i >= least) & x.rlike(f"(?i){T.CUT_SCAN}"), i)), lambda i: i.isNotNull()))
        return F.when(F.size(lines) < 12, T.stripped(text)).otherwise(T.let(F.coalesce(cut, F.size(lines)), lambda n: F.array_join(F.slice(lines, F.lit(1), n), "\n")))

    return T.let(T.lines_of(text), kept)


def title_parts(title: Column) -> Column:
    """A title and its parts between marks, of four characters or more."""
    name = T.stripped(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(name), F.split(name, r"(?U)\s*[|｜/\-–—:：]+\s*")), lambda x: F.btrim(x, F.lit(" -|｜/:："))), lambda x: F.length(x) >= 4))


def _part_anchor(text: Column, title: Column) -> Column:
    def score(t: Column, x: Column) -> Column:
        shells = T.let(T.lines_of(F.substr(t, F.lit(1), x["p"])), lambda v: F.size(F.filter(F.slice(v, F.greatest(F.size(v) - 17, F.lit(1)), F.lit(18)), shell_line)))
        return T.let(shells, lambda n: x["p"] + n * 140 + F.when(n >= 6, 180).otherwise(0))

    brief = lambda words, _, x: F.when(F.length(F.get(words, x["k"])) <= 8, 80).otherwise(0)
    return _from_anchor(text, title_parts(title), lambda n: F.least(F.lit(3200), F.greatest(F.lit(900), F.floor(n * 0.45).cast("int"))), score, brief)


def clean_content(pages: DataFrame) -> DataFrame:
    """pages (text, title, url; text sanitized before) without footnote marks, the shell before title or first prose, and closing sections; the title becomes a heading where the first line lacks it. Each step is a projection of its own, so that no text is computed twice."""
    text, title = F.col("text"), F.col("title")
    inline = F.length(F.split(text, C.CUT_INLINE, 2)[0])
    wiki = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/?#]+://([^/?#]*)", 1)).contains("wikipedia.org")
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), C.FOOTNOTE, ""), r"\n\^+\s*\n", "\n"), "(?m)^(?:維基百科，自由的百科全書|取自「)[ \t]*$", "")
    steps = (
        marks, _part_anchor(text, title), trim_shell(text), trim_sections(text), F.when((inline >= 240) & (inline < F.length(text)), F.substr(text, F.lit(1), inline)).otherwise(text),
        F.when(wiki, F.regexp_replace(text, r"(?m)^[ \t]*[\[\]編輯\s\d.]+[ \t]*$", "")).otherwise(text), F.when(wiki, trim_sections(text)).otherwise(text),
        T.stripped(F.regexp_replace(text, r"\n{3,}", "\n\n")), title_of_body(text, title),
    )
    for step in steps:
        pages = pages.withColumn("text", step)
    return pages


def clean_pdf_content(text: Column, title: Column) -> Column:
    """PDF text (sanitized before) keeps its pages and paragraphs; only the heading is added."""
    return title_of_body(T.stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n")), title)


def title_of_body(text: Column, title: Column) -> Column:
    """A heading before a text whose first line is none and lacks the title's first 18 characters."""
    name = T.stripped(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    first = lambda t: F.split(t, "\n", 2)[0]
    bare = lambda t: (t != "") & (F.coalesce(title, F.lit("")) != "") & ~first(t).startswith("#") & ~first(t).contains(F.substring(title, 1, 18))
    return T.let(text, lambda t: F.when(bare(t), F.concat(F.lit("# "), name, F.lit("\n\n"), t)).otherwise(t))


def trim_leading(text: Column) -> Column:
    """Interface and breadcrumb lines before the first line of prose (80 characters, or a sentence mark) go; headings stay."""

    def kept(lines: Column) -> Column:
        prose = F.filter(F.transform(lines, lambda x, i: F.when((F.length(x) >= 80) | x.rlike(SENTENCE), i)), lambda i: i.isNotNull())
        first = F.coalesce(F.array_min(prose), F.lit(0))
        noise = lambda x: ~x.startswith("#") & (x.rlike(f"(?i){T.LEADING_SCAN}") | x.rlike(r"^[-|>/\s]+"))
        return T.let(F.struct(lines.alias("l"), first.alias("first")), lambda b: F.array_join(F.filter(b["l"], lambda x, i: (i >= b["first"]) | ~noise(x)), "\n"))

    return T.let(T.lines_of(text), kept)


def trim_trailing(text: Column) -> Column:
    """The text up to the first section word in its last part, and up to the last line of prose before that; at least two lines stay."""

    def cut(lines: Column) -> Column:
        n, whole = F.size(lines), F.array_join(lines, "\n")
        start = F.greatest(F.lit(2), F.floor(n * 0.55).cast("int"), n - 20)
        hits = F.filter(F.transform(lines, lambda x, i: F.when((i >= start) & x.rlike(f"(?i){T.TRAILING_SCAN}"), i)), lambda i: i.isNotNull())
        prose = lambda upto: F.array_max(F.filter(F.transform(lines, lambda x, i: F.when((i < upto) & ((F.length(x) > 120) | x.rlike(SENTENCE)), i)), lambda i: i.isNotNull()))
        at = T.let(F.array_min(hits), lambda h: F.greatest(F.coalesce(prose(h), F.lit(0)) + 1, F.lit(1)))
        return T.let(whole, lambda w: F.when((n >= 4) & T.may_match(w, C.TRAILING) & (F.size(hits) > 0) & (at >= 2), F.array_join(F.slice(lines, F.lit(1), at), "\n")).otherwise(w))

    return T.let(T.lines_of(text), cut)


def title_heading(text: Column, title: Column) -> Column:
    """A title that is not in the first four lines goes before them as a heading; a first line that is the title becomes one."""
    name = F.trim(F.coalesce(title, F.lit("")))

    def headed(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        body = F.array_join(lines, "\n")
        head = F.lower(F.array_join(F.slice(lines, 1, 4), "\n"))
        return (
            F.when(F.size(lines) == 0, "").when(first.startswith("#"), body).when(F.lower(first) == F.lower(name), F.concat(F.lit("# "), body))
            .when((F.length(name) >= 12) & ~head.contains(F.lower(name)), F.concat(F.lit("# "), name, F.lit("\n\n"), body)).otherwise(body)
        )

    return T.let(T.lines_of(text), headed)


def _recorded(pages: DataFrame, name: str, fix) -> DataFrame:
    """pages with text after one step, which is recorded."""
    # the task number, which is not a function of the row, keeps the step a projection of its own: merged with those that read it, it would be computed for each
    fixed = pages.withColumn("_t", F.struct(fix(F.coalesce("text", F.lit(""))).alias("text"), F.spark_partition_id().alias("task")))
    step = F.struct(F.lit(name).alias("step"), F.length(F.coalesce("text", F.lit(""))).alias("before"), F.length("_t.text").alias("after"))
    return fixed.withColumn("steps", F.concat("steps", F.array(step))).withColumn("text", F.col("_t.text")).drop("_t")


def _by_mode(pages: DataFrame) -> DataFrame:
    """pages in the modes in which they go on: ``both`` where strict finds no heading to begin with, else one row for general and one for strict."""
    # strict looks for a heading only in texts that no step before has changed
    headed = F.when(F.col("text") == T.stripped(F.col("_whole")), heading_anchor(F.col("text"))).otherwise(F.col("text"))
    made = pages.withColumn("_t", F.struct(headed.alias("text"), F.spark_partition_id().alias("task")))
    row = lambda mode, text: F.struct(F.lit(mode).alias("mode"), text.alias("text"))
    ways = F.when(F.col("_t.text") == F.col("text"), F.array(row("both", F.col("text")))).otherwise(F.array(row("general", F.col("text")), row("strict", F.col("_t.text"))))
    step = F.array(F.struct(F.lit("heading").alias("step"), F.length("text").alias("before"), F.length("m.text").alias("after")))
    each = made.withColumn("m", F.explode(ways)).withColumn("steps", F.when(F.col("m.mode") == "general", F.col("steps")).otherwise(F.concat("steps", step)))
    return each.withColumns({"mode": F.col("m.mode"), "text": F.col("m.text")}).drop("_t", "m")


def postprocess(pages: DataFrame, mode: str = "general") -> DataFrame:
    """pages (text, title) with the trimmed text and ``steps``: name and length before and after each.

    Mode strict also looks for a heading to begin with. With ``both``, all that the modes share is done once: ``mode`` says for
    which a row stands (general, strict, or both), and a page has one row or two.
    """
    title = F.col("title")
    out = pages.withColumns({"steps": F.array().cast("array<struct<step:string,before:int,after:int>>"), "_whole": F.coalesce("text", F.lit(""))})
    for name, fix in (("links", T.strip_md_links), ("x", lambda t: F.regexp_replace(t, r"(?iU)^\s*x\s+", "")), ("anchor", lambda t: title_anchor(t, title))):
        out = _recorded(out, name, fix)
    if mode != "general":
        out = _by_mode(out)
        out = out if mode == "both" else out.filter("mode <> 'general'").drop("mode")
    single = lambda t: F.when(F.contains(t, F.lit("  ")) | t.rlike(T.ODD_BLANK), F.regexp_replace(t, r"(?U)[^\S\n]{2,}|[^\S\n ]", " ")).otherwise(t)
    few = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    spaced = lambda t: T.stripped(T.let(T.let(t, single), few))
    for name, fix in (("leading", trim_leading), ("trailing", trim_trailing), ("title", lambda t: title_heading(t, title)), ("spacing", spaced)):
        out = _recorded(out, name, fix)
    return out.drop("_whole")


def clean_step_stats(pages: DataFrame) -> DataFrame:
    """Of each step: pages, pages that it changed in length, lengths before and after, and the difference."""
    s = pages.select(F.explode("steps").alias("s")).select("s.*")
    sums = s.groupBy("step").agg(F.count("*").alias("pages"), F.count_if(F.col("before") != F.col("after")).alias("changed"), F.sum("before").alias("before_len"), F.sum("after").alias("after_len"))
    return sums.withColumn("delta", F.col("after_len") - F.col("before_len"))
