"""Text functions as column expressions: tokens, terms, cuts, chunk ids, page quality."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .markup import page

NAV = f"(?:{'|'.join((*C.NAV_MARKS, *(rf'\b{w}\b' for w in C.NAV_WORDS)))})"


def scan(pattern: str) -> str:
    """The same matches as of ``(?:a|b|...)`` in either case, found sooner: the first character is looked at before a word boundary is, and alternatives are tried only where they begin so.

    An alternative begins with a plain character, before which ``\\b`` or ``^`` may stand.
    """
    body, depth, ends = re.fullmatch(r"\(\?:(.*)\)", pattern, re.S)[1], 0, [-1]
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            ends.append(i)
    kinds: dict[str, dict[str, list[str]]] = {}
    for a, b in zip(ends, [*ends[1:], len(body)]):
        lead, first, rest = re.fullmatch(r"(\\b|\^)?(.)(.*)", body[a + 1 : b], re.S).groups("")
        if first in "\\.[(^$" or rest[:1] in ("?", "*", "+", "{") or any(first.lower() in own for other, own in kinds.items() if other != lead):
            raise ValueError(f"no plain beginning: {body[a + 1 : b]}")
        kinds.setdefault(lead, {}).setdefault(first.lower(), []).append(rest)
    each = lambda own: "|".join(f"{first}(?:{'|'.join(dict.fromkeys(rests))})" for first, rests in own.items())
    # a class of many single characters is slow beyond ASCII, where their range stands for them
    span = lambda own: "".join(own) if max(own) < "\x80" else "".join(c for c in own if c < "\x80") + f"{min(c for c in own if c >= '\x80')}-{max(own)}"
    return "(?:" + "|".join(f"{lead if lead == '^' else ''}(?=[{span(own)}]){lead if lead != '^' else ''}(?:{each(own)})" for lead, own in kinds.items()) + ")"


def needs(pattern: str) -> tuple[str, ...]:
    """Plain words, of which every match of ``(?:a|b|...)`` has one: the longest piece of each alternative that no sign makes optional."""
    body, depth, ends = re.fullmatch(r"\(\?:(.*)\)", pattern, re.S)[1], 0, [-1]
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            ends.append(i)
    found = set()
    for a, b in zip(ends, [*ends[1:], len(body)]):
        plain = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\][?*+]?", "\0", body[a + 1 : b])
        pieces = re.split("[\0^$]+", re.sub(r"\\.[?*+]?|[^\\][?*]|[.+]+", "\0", plain))
        if not (longest := max(pieces, key=len).lower()):
            raise ValueError(f"no plain part: {body[a + 1 : b]}")
        found.add(longest)
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def may_match(text: Column, pattern: str) -> Column:
    """Whether a match of ``(?:a|b|...)`` in either case is not ruled out by plain searches, which cost little beside the pattern."""
    words = needs(pattern)
    near, far = [w for w in words if w.isascii()], sorted({next(c for c in w if c > "\x7f") for w in words if not w.isascii()})
    has = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in near))
    tests = ([let(F.lower(text), has)] if near else []) + ([text.rlike(f"[{far[0]}-{far[-1]}]")] if far else [])
    return reduce(lambda a, b: a | b, tests)


def count_marks(text: Column, pattern: str) -> Column:
    """How many matches of ``(?:a|b|...)`` in either case a text has."""
    return let(text, lambda t: F.when(may_match(t, pattern), count(t, scan(pattern))).otherwise(0))


NAV_SCAN, LEADING_SCAN, TRAILING_SCAN, SHELL_SCAN, CUT_SCAN, UI_SCAN, ITEM_SCAN = map(scan, (NAV, C.LEADING_UI, C.TRAILING, C.SHELL_LINE, C.CUT_LINE, C.COMMENT_UI, C.COMMENT_ITEM))
BREAK = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028-\\u2029]"
HAN = "[㐀-鿿]"
#: What a text has that holds white space but for the line feed and the plain space; a few wide marks are among it, as one range is found sooner than many.
ODD_BLANK = "[\\t\\x0b\\f\\r\\x85\\xa0\\u1680-\\u3000]"
#: White space of Unicode.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(BLANK))


def lines_of(text: Column) -> Column:
    """Trimmed lines with something in them."""
    # the empty line within \r\n goes with the others; where the line feed is the only break, no pattern is needed
    odd = lambda t: t.rlike(r"[\r\x0b\x0c\x1c-\x1e\x85]") | F.contains(t, F.lit("\u2028")) | F.contains(t, F.lit("\u2029"))
    pieces = let(F.coalesce(text, F.lit("")), lambda t: F.when(odd(t), F.split(t, BREAK)).otherwise(F.split(t, "\n")))
    return F.filter(F.transform(pieces, stripped), lambda x: x != "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, also inside of nested lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count(text: Column, pattern: str, flags: str = "(?i)") -> Column:
    return F.regexp_count(text, F.lit(flags + pattern))


def est_tokens(text: Column) -> Column:
    """One token for each Han character, one for every four others begun."""
    text = F.coalesce(text, F.lit(""))
    han = F.regexp_count(text, F.lit(HAN))
    return (han + F.floor((F.length(text) - han + 3) / 4)).cast("long")


def review_terms(*texts: Column) -> Column:
    """Distinct terms of the texts in order, at most 24."""
    found = F.concat(*(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(C.REVIEW_TERM), 0) for t in texts))
    return F.slice(F.array_distinct(found), 1, C.MOST_TERMS)


def term_hits(text: Column, terms: Column) -> Column:
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda lowered: F.size(F.filter(terms, lambda t: F.contains(lowered, t)))).cast("long")


def chunk_score(text: Column, position: Column, terms: Column) -> Column:
    """Position bonus (2, 1, 0), 1.25 for each term in the text, and how much of the target length it fills."""
    bonus = F.when(position == 0, 2.0).when(position == 1, 1.0).otherwise(0.0)
    size = F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(C.CHUNK_TARGET)) / C.CHUNK_TARGET
    return bonus + term_hits(text, terms) * 1.25 + size


def chunk_id(round_: Column, source: Column, chunk: Column) -> Column:
    one = lambda c: F.greatest(c, F.lit(1)).cast("long")
    return F.format_string("L%d-S%d-C%03d", one(round_), one(source), one(chunk))


def preview(text: Column, most: int = 280) -> Column:
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(squeezed) > most, F.concat(F.rtrim(F.substring(squeezed, 1, most - 3)), F.lit("…"))).otherwise(squeezed)


def cut(text: Column, most: Column | int) -> Column:
    """Head and tail of a long text with a mark between them; 72 % head."""
    most = F.lit(most) if isinstance(most, int) else most
    content = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    head = F.greatest(F.lit(80), F.floor(most * 0.72).cast("int"))
    tail = F.greatest(F.lit(40), most - head - 24)
    start = F.regexp_replace(F.substr(content, F.lit(1), head), r"(?U)\s+$", "")
    end = F.regexp_replace(F.substr(content, F.greatest(F.length(content) - tail + 1, F.lit(1)), tail), r"(?U)^\s+", "")
    return F.when(F.length(content) <= most, content).otherwise(F.concat(start, F.lit("\n…（內容已受控截短）…\n"), end))


def excerpt(text: Column, most: int = 1200) -> Column:
    """Of a long answer: up to seven headings and list items, first and last line, without repeats, cut to length."""
    content = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = lines_of(content)
    marks = F.slice(F.filter(lines, lambda x: x.rlike(r"^(#|- |\* |•|1\.|2\.|3\.)")), 1, 7)
    parts = F.array_distinct(F.concat(F.array(F.lit("（較早回答的受控摘錄）")), marks, F.array(F.element_at(lines, 1), F.element_at(lines, -1))))
    return F.when(F.length(content) <= most, content).otherwise(cut(F.array_join(parts, "\n"), most))


def smart_truncate(text: Column, limit: int) -> Column:
    """Cut at the last boundary mark within 180 characters of the limit that keeps 60 %, else at the limit."""
    window = F.substring(text, max(0, limit - 180) + 1, min(limit, 180))
    out = F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", "")
    for mark in reversed(("\n\n", "。", ". ", "\n", "，", ", ", " ")):
        from_end = F.instr(F.reverse(window), mark[::-1])
        end = max(0, limit - 180) + F.length(window) - from_end + 1
        kept = F.regexp_replace(F.substr(text, F.lit(1), end.cast("int")), r"(?U)^\s+|\s+$", "")
        out = F.when((from_end > 0) & (F.length(kept) >= int(limit * 0.6)), kept).otherwise(out)
    return F.when(F.length(text) <= limit, text).otherwise(out)


def strip_md_links(text: Column) -> Column:
    """Markdown links become their text; images, script links and advertisement marks go; space is squeezed."""
    # what a step needs is looked for by plain searches, as most texts have none of it
    has = lambda *marks: lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))
    steps = (
        (has("["), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[\s*\]\(\s*[^)]*\)", ""), (r"(?i)\[([^\]]*)\]\(\s*javascript:[^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1")),
        (has("("), (r"(?i)javascript:void\\?\([^)]*\)", "")), (has('")'), (r"\s*;\s*\"[^\"]*\"\)", "")), (has("__"), (r"(?i)__+\s*advertisement\s*__+", "")),
        (lambda t: t.rlike("(?i)advertisement"), (r"(?i)\badvertisement\b", "")), (has("\r"), (r"\r\n?", "\n")), (lambda t: F.contains(t, F.lit("  ")) | t.rlike(ODD_BLANK), (r"(?U)[^\S\n]{2,}|[^\S\n ]", " ")),
        (has(" \n", "\n "), (r" \n ?|\n ", "\n")), (has("\n\n\n"), (r"\n{3,}", "\n\n")),
    )
    out = F.coalesce(text, F.lit(""))
    for needed, *fixes in steps:
        out = let(out, lambda t: F.when(needed(t), reduce(lambda x, fix: F.regexp_replace(x, *fix), fixes, t)).otherwise(t))  # noqa: B023
    return stripped(out)


def language_class(text: Column, html: Column | None = None) -> Column:
    """cjk, thai or latin: by ``<html lang>`` where there is one, else by the characters of the start."""
    html = F.lit("") if html is None else F.coalesce(html, F.lit(""))
    named = F.lower(F.regexp_extract(F.substring(html, 1, 3000), r"(?i)<html[^>]+lang=['\"]([a-zA-Z-]+)['\"]", 1))
    sample = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    # counting makes an array of all matches: only where there is one, and Latin letters only where they decide
    some = lambda pattern: F.when(sample.rlike(pattern), F.regexp_count(sample, F.lit(pattern))).otherwise(0)
    cjk, thai = some("[㐀-䶿一-鿿぀-ヿ가-힯]"), some("[฀-๿]")
    many = (cjk >= 16) | ((cjk > 8) & (cjk > F.floor(F.regexp_count(sample, F.lit("[A-Za-z]")) / 2)))
    return (
        F.when(named.rlike("^(zh|ja|ko)"), "cjk").when(named.startswith("th"), "thai").when(named != "", "latin")
        .when(sample == "", "latin").when(many, "cjk").when(thai >= 16, "thai").otherwise("latin")
    )


def profile(lang: Column, k: int) -> Column:
    """Column k of the profile of a language class."""
    return F.when(lang == "cjk", C.PROFILES["cjk"][k]).when(lang == "thai", C.PROFILES["thai"][k]).otherwise(C.PROFILES["latin"][k])


def js_signals(html: Column, text: Column) -> Column:
    sample = F.concat(F.substring(F.coalesce(html, F.lit("")), 1, 5000), F.lit("\n"), F.substring(text, 1, 1200))
    # plain searches first, as most pages have none
    may = lambda low: F.contains(low, F.lit("javascript")) | F.contains(low, F.lit("window.__n")) | (F.contains(low, F.lit("<div")) & F.contains(low, F.lit("id=")))
    return let(sample, lambda s: F.when(let(F.lower(s), may), sum(s.rlike(f"(?i){p}").cast("int") for p in C.JS_SIGNALS)).otherwise(0))


def nav_hits(text: Column, most: int = 4000) -> Column:
    """How many navigation marks and words the start of a text has."""
    return count_marks(F.substring(text, 1, most), NAV)


def content_metrics(text: Column, html: Column | None = None) -> Column:
    """quality_score, text_len, line_count, short_line_ratio, nav_hits, js_signals, language_hint of a page text."""
    page = html if html is not None else F.lit("")

    def base(t: Column) -> Column:
        nav = F.when(t == "", 0).otherwise(nav_hits(t))
        return F.struct(t.alias("t"), language_class(t, html).alias("lang"), lines_of(t).alias("lines"), nav.alias("nav"), js_signals(page, t).alias("js"))

    def lines(b: Column) -> Column:
        plain = F.filter(b["lines"], lambda x: ~x.startswith("#"))
        scored = F.when(F.size(plain) > 0, plain).otherwise(b["lines"])
        sizes = F.struct(F.transform(scored, lambda x: F.length(x)).alias("of"), profile(b["lang"], 0).alias("short"), profile(b["lang"], 1).alias("long"))
        return let(sizes, lambda s: F.struct(b.alias("b"), (F.size(F.filter(s["of"], lambda n: n <= s["short"])) / F.greatest(F.size(s["of"]), F.lit(1))).alias("ratio"), F.size(F.filter(s["of"], lambda n: n >= s["long"])).alias("longs")))

    def measured(m: Column) -> Column:
        b = m["b"]
        ratio = F.when(b["t"] == "", 1.0).otherwise(m["ratio"])
        score = F.greatest(F.lit(0), F.least(F.length(b["t"]), F.lit(20000)) + F.least(m["longs"] * 120, F.lit(1200)) - F.floor(ratio * 1800) - F.least(b["nav"] * 120, F.lit(2400)))
        return F.struct(
            F.when(b["t"] == "", 0).otherwise(score).cast("int").alias("quality_score"), F.length(b["t"]).alias("text_len"), F.size(b["lines"]).alias("line_count"),
            ratio.alias("short_line_ratio"), b["nav"].alias("nav_hits"), b["js"].alias("js_signals"), b["lang"].alias("language_hint"),
        )

    return let(let(let(stripped(F.coalesce(text, F.lit(""))), base), lines), measured)


def low_value_reason(text: Column) -> Column:
    def judged(b: Column) -> Column:
        sample = b["t"]
        out = F.when(sample == "", "EMPTY_CONTENT")
        for pattern, reason in C.LOW_VALUE:
            # the last word of a pattern is plain, and a plain search is cheap
            word = re.findall("[a-z]+", pattern)[-1]
            out = out.when(F.contains(b["lowered"], F.lit(word)) & sample.rlike(f"(?i){pattern}"), reason)
        return out.when((F.length(sample) <= 20) & (F.regexp_count(sample, F.lit(r"(?U)\S+")) <= 3), "LOW_INFO_CONTENT")

    return let(let(stripped(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("t"), F.lower(t).alias("lowered"))), judged)


def quality_gate(text: Column, m: Column) -> Column:
    """usable, acceptable, reason of a page text with its metrics."""

    def judged(b: Column) -> Column:
        m, low = b["m"], b["low"]
        score, size, lang = m["quality_score"], m["text_len"], m["language_hint"]
        bad = (
            F.when(low.isNotNull(), low).when(size < 40, "TEXT_TOO_SHORT").when((score <= 0) & (m["short_line_ratio"] >= 0.85), "LOW_SIGNAL_CONTENT")
            .when((score < profile(lang, 4)) & (size < max(C.TEXT_FORCE_JS, C.SUCCESS_MIN)), "LOW_SIGNAL_CONTENT")
            .when((m["nav_hits"] >= 12) & (score < 200), "NAV_HEAVY_CONTENT").when((size < C.SUCCESS_MIN) & (score < profile(lang, 3)), "LOW_VALUE_CONTENT")
        )
        fine = ((size >= C.TEXT_ACCEPT) & (score >= profile(lang, 2))) | ((size >= C.LONG_LENGTH) & (score >= C.LONG_SCORE) & (m["nav_hits"] <= C.LONG_NAV) & (m["short_line_ratio"] <= C.LONG_SHORT_RATIO))
        return F.struct(bad.isNull().alias("usable"), (bad.isNull() & fine).alias("acceptable"), F.coalesce(bad, F.when(~fine, "BELOW_ACCEPT_THRESHOLD")).alias("reason"))

    # bound once: an optimizer that moves a filter on the result would otherwise repeat what it is made of
    return let(F.struct(m.alias("m"), let(text, low_value_reason).alias("low")), judged)


def content_scope(text: Column) -> Column:
    shell = lambda t: F.when(may_match(t, C.COMMENT_UI) & t.rlike(f"(?i){UI_SCAN}"), "article_only_or_comment_shell").otherwise("general")
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(count_marks(t, C.COMMENT_ITEM) >= 2, "article_plus_comments").otherwise(shell(t)))


def comments_dynamic(text: Column, m: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (count(text, C.COMMENT_ITEM) == 0) & (m["text_len"] >= 300) & text.rlike(f"(?i){C.COMMENT_DYNAMIC}") & (count(text, C.COMMENT_UI) >= 1)


def needs_render(status: Column, html_len: Column, text: Column, m: Column, q: Column, render: Column) -> Column:
    """Why a page has to be rendered, by ordered rules; null if it need not be."""
    force = profile(m["language_hint"], 3)
    return (
        F.when(render == "never", F.lit(None).cast("string")).when(render == "always", "render_always")
        .when(q["reason"].isNotNull() & (q["reason"] != "BELOW_ACCEPT_THRESHOLD"), q["reason"])
        .when(comments_dynamic(text, m), "comments_likely_dynamic").when(status.isin(403, 429), F.concat(F.lit("status_"), status.cast("string")))
        .when(m["text_len"] < C.TEXT_FORCE_JS, "text_too_short").when(m["quality_score"] < force, "quality_too_low")
        .when((html_len > 20000) & (m["text_len"] < C.TEXT_FORCE_JS), "spa_shell_suspected").when(q["acceptable"], F.lit(None).cast("string"))
        .when(m["js_signals"] >= 1, "js_signal_detected").otherwise(F.coalesce(q["reason"], F.lit("below_accept_threshold")))
    )


def error_class(message: Column, default: str = "JS_CRAWL_ERROR") -> Column:
    m = F.coalesce(message, F.lit(""))
    return F.when(m.rlike(f"(?i){C.BROWSER_MISSING}"), "JS_BROWSER_MISSING").when(m.rlike(f"(?i){C.ANTI_BOT}"), "JS_ANTI_BOT_BLOCKED").otherwise(default)


def error_label(code: Column, default: str = "EXTRACT_EMPTY") -> Column:
    """An error code in upper snake case; the default where nothing is left of it."""
    return F.upper(F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.coalesce(F.nullif(code, F.lit("")), F.lit(default)), "[^A-Za-z0-9_]+", "_"), F.lit("_")), F.lit("")), F.lit(default)))


def resource_type(url: Column, content_type: Column, body: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(F.substring(body, 1, 5) == F.lit(b"%PDF-"), "pdf").when(kind.contains("application/pdf") | kind.contains("application/x-pdf"), "pdf")
        .when(kind.contains("text/html") | kind.contains("application/xhtml+xml"), "html").when(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".pdf"), "pdf").otherwise("other")
    )


def html_to_text(html: Column) -> Column:
    """Text of a page without scripts, navigation and other shells, a line for each piece between tags."""
    return page(html)["text"]


def structural_text(html: Column) -> Column:
    """The longest text among the first three article, main and marked elements; earlier kinds win ties."""
    return let(page(html), lambda p: F.struct(p["main"].alias("text"), p["main_source"].alias("source")))


def extract_title(html: Column, text: Column | None = None) -> Column:
    return page_title(page(html), text)


def page_title(found: Column, text: Column | None = None) -> Column:
    """Of what ``markup.page`` found: the first top heading of 12 characters or more, else the title, else a leading heading line of the text; 200 characters at most."""
    first = F.lit("") if text is None else F.regexp_extract(F.coalesce(text, F.lit("")), r"^#+\s*([^\n]*)", 1)
    return let(found, lambda p: F.substring(F.when(F.length(p["h1"]) >= 12, p["h1"]).when(p["title"] != "", p["title"]).otherwise(first), 1, 200))
