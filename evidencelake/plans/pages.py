"""Registered queries on pages, with their SQL twins."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import pages as P
from ..operators.extraction import read_pages as read_both
from ..sources.tables import CRAWL_LOG, read_pages, table


BACK = "\\"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lines_sql(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


#: Named character references as chr(2) name chr(3) characters, and the names that also count without a semicolon, longest first.
ENTITIES = "".join(f"\2{name}\3{chars}" for name, chars in html5.items()) + "\2"
BARE = "^(?:" + "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda x: (-len(x), x))) + ")"
NUMBER = "^#([0-9]+|[xX][0-9a-fA-F]+);?"
#: What str.strip takes away.
BLANK = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
SPACE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}"
#: Tags as ``markup.TAG`` has them: a bare < or > is text, and a quoted > ends no tag.
TAG = f"""(?s)<!--.*?(?:-->|\\z)|</?[A-Za-z][^{SPACE}/>]*(?:[^>"']|"[^"]*"|'[^']*')*>|</?[A-Za-z][^{SPACE}/>]*[^>]*>|<[!?][^>]*>"""


def entities_sql(x: str) -> str:
    """Character references read as HTML reads them: all names, old ones without semicolon and as prefixes too, and numbers with their replacements."""
    table, named = lit(ENTITIES), "regexp_extract(p, '^[^\\t\\n\\f <#;]{1,32};?')"
    value = lambda name: f"split_part(substring({table}, strpos({table}, chr(2) || {name} || chr(3)) + length({name}) + 2, 8), chr(2), 1) || substring(p, length({name}) + 1)"
    bare, digits = f"regexp_extract(p, '{BARE}')", f"regexp_extract(p, '{NUMBER}', 1)"
    code = f"CASE WHEN regexp_matches({digits}, '^([xX]0*[^xX0].{{7}}|0*[1-9][0-9]{{7}})') THEN 1114112 WHEN {digits} ILIKE 'x%' THEN ('0x' || right('0000000' || substring({digits}, 2), 7))::BIGINT ELSE right('0000000' || {digits}, 7)::BIGINT END"
    latin = " ".join(f"WHEN {n} THEN {lit(bytes([n]).decode('cp1252'))}" for n in range(128, 160) if n not in (129, 141, 143, 144, 157))
    char = f"list_transform([{code}], lambda n: CASE n {latin} ELSE CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END END)[1]"
    read = f"CASE WHEN regexp_matches(p, '{NUMBER}') THEN {char} || regexp_replace(p, '{NUMBER}', '') WHEN {named} <> '' AND strpos({table}, chr(2) || {named} || chr(3)) > 0 THEN {value(named)} WHEN {bare} <> '' THEN {value(bare)} ELSE '&' || p END"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {read} END), '') ELSE {x} END"


def texts_sql(h: str) -> str:
    """Texts between tags, with their character references read, without blank ones."""
    return f"list_filter(list_transform(string_split(regexp_replace({h}, {lit(TAG)}, chr(1), 'g'), chr(1)), lambda t: regexp_replace({entities_sql('t')}, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda t: t <> '')"


def html_text_sql(h: str) -> str:
    out = h  # an element that is cut off hides the rest of the page
    for tag in ("script", "style", "noscript", "iframe", "svg", "canvas", "nav", "footer", "aside", "header", "form"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?(?:</{tag}\\s*>|\\z)', '', 'g')"
    return f"regexp_replace(regexp_replace(array_to_string({texts_sql(out)}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')"


def n_sql(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {lit('(?i)' + pattern)}))"


def profile_sql(k: int) -> str:
    return f"CASE lang WHEN 'cjk' THEN {C.PROFILES['cjk'][k]} WHEN 'thai' THEN {C.PROFILES['thai'][k]} ELSE {C.PROFILES['latin'][k]} END"


#: metrics of (id, text, html) rows named t.
METRICS = f"""m0 AS (SELECT id, html, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS text, lower(regexp_extract(substring(html, 1, 3000), '(?i)<html[^>]+lang=[''"]([a-zA-Z-]+)[''"]', 1)) AS named FROM t),
m1 AS (SELECT *, CASE WHEN regexp_matches(named, '^(zh|ja|ko)') THEN 'cjk' WHEN named LIKE 'th%' THEN 'thai' ELSE 'latin' END AS lang, {lines_sql('text')} AS lines FROM m0),
m2 AS (SELECT *, CASE WHEN len(list_filter(lines, lambda x: x NOT LIKE '#%')) > 0 THEN list_filter(lines, lambda x: x NOT LIKE '#%') ELSE lines END AS scored, {profile_sql(0)} AS a, {profile_sql(1)} AS b FROM m1),
m3 AS (SELECT *, CASE WHEN text = '' THEN 1.0 ELSE len(list_filter(scored, lambda x: length(x) <= a)) / greatest(len(scored), 1)::DOUBLE END AS ratio, len(list_filter(scored, lambda x: length(x) >= b)) AS longs, {n_sql('substring(text, 1, 4000)', T.NAV)} AS nav FROM m2),
metrics AS (SELECT id, html, text, lang, length(text) AS text_len, len(lines) AS line_count, ratio AS short_line_ratio, nav AS nav_hits,
 {' + '.join(f"CAST(regexp_matches(substring(html, 1, 5000) || chr(10) || substring(text, 1, 1200), {lit('(?i)' + p)}) AS INT)" for p in C.JS_SIGNALS)} AS js_signals,
 CASE WHEN text = '' THEN 0 ELSE greatest(0, least(length(text), 20000) + least(longs * 120, 1200) - floor(ratio * 1800) - least(nav * 120, 2400)) END::INT AS quality_score FROM m3)"""
LOW = "CASE WHEN text = '' THEN 'EMPTY_CONTENT' " + " ".join(f"WHEN regexp_matches(text, {lit('(?i)' + p)}) THEN '{r}'" for p, r in C.LOW_VALUE) + r" WHEN length(text) <= 20 AND len(regexp_extract_all(text, '\S+')) <= 3 THEN 'LOW_INFO_CONTENT' END"
GATE = f"""g0 AS (SELECT *, {LOW} AS low, {profile_sql(2)} AS accept, {profile_sql(3)} AS force, {profile_sql(4)} AS least_usable FROM metrics),
g1 AS (SELECT *, CASE WHEN low IS NOT NULL THEN low WHEN text_len < 40 THEN 'TEXT_TOO_SHORT' WHEN quality_score <= 0 AND short_line_ratio >= 0.85 THEN 'LOW_SIGNAL_CONTENT' WHEN quality_score < least_usable AND text_len < 220 THEN 'LOW_SIGNAL_CONTENT'
 WHEN nav_hits >= 12 AND quality_score < 200 THEN 'NAV_HEAVY_CONTENT' WHEN text_len < 120 AND quality_score < force THEN 'LOW_VALUE_CONTENT' END AS bad,
 (text_len >= 450 AND quality_score >= accept) OR (text_len >= 650 AND quality_score >= 420 AND nav_hits <= 8 AND short_line_ratio <= 0.72) AS fine FROM g0),
gate AS (SELECT *, bad IS NULL AS usable, bad IS NULL AND fine AS acceptable, coalesce(bad, CASE WHEN NOT fine THEN 'BELOW_ACCEPT_THRESHOLD' END) AS reason FROM g1)"""
#: Pages, a null one as an empty one.
WHOLE = "(SELECT page_id, coalesce(html, '') AS html FROM pages)"
PAGE_T = f"t AS (SELECT page_id AS id, html, {html_text_sql('html')} AS text FROM {WHOLE})"
DOC_T = "t AS (SELECT doc_id AS id, '' AS html, coalesce(text, '') AS text FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("m", T.content_metrics(F.col("text")))


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html", T.html_to_text(F.col("html")).alias("text")).withColumn("m", T.content_metrics(F.col("text"), F.col("html")))


def s10_pages(spark, d):
    return read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("html_len"))


def f17_html_text(spark, d):
    return _pages(spark, d).select("id", "text")


def f18_structural(spark, d):
    """Pages as they are, and with an article and a menu within their article."""
    pages = table(spark, d, "pages").select("page_id", F.explode(F.array(F.struct(F.lit(False).alias("nested"), F.col("html").alias("html")), F.struct(F.lit(True).alias("nested"), F.replace("html", F.lit("<h1>"), F.lit(NESTED + "<h1>")).alias("html")))).alias("p"))
    return pages.select("page_id", "p.nested", T.structural_text(F.col("p.html")).alias("s")).select("page_id", "nested", "s.text", "s.source")


NESTED = "<nav>menu<nav>in a menu</nav>rest of it</nav><article><p>Part of it.</article>"
#: An article that shows nothing is none.
F18_ALONE = f"SELECT page_id, text, CASE WHEN text = '' THEN 'empty' ELSE 'html_article' END AS source, headed FROM (SELECT page_id, {html_text_sql(chr(34) + 'a' + chr(34))} AS text, headed FROM (SELECT page_id, regexp_extract(html, '(?is)<article\\b[^>]*>.*?(?:</article\\s*>|\\z)') AS a, contains(html, '<h1>') AS headed FROM {WHOLE}))"
F18_SQL = f"WITH s AS ({F18_ALONE}) SELECT page_id, false AS nested, text, source FROM s UNION ALL SELECT page_id, true, CASE WHEN headed THEN 'Part of it.' || CASE WHEN text = '' THEN '' ELSE chr(10) || text END ELSE text END, CASE WHEN headed THEN 'html_article' ELSE source END FROM s"


def f19_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.extract_title(F.col("html")).alias("title"))


F19_SQL = f"""SELECT page_id, substring(CASE WHEN length(h) >= 12 THEN h ELSE t END, 1, 200) AS title FROM (SELECT page_id, array_to_string({texts_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ' ') AS h,
 array_to_string({texts_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ' ') AS t FROM {WHOLE})"""


def f16_language(spark, d):
    return table(spark, d, "pages").select("page_id", T.language_class(F.col("html"), F.col("html")).alias("lang"))


def g13_metrics(spark, d):
    return _pages(spark, d).select("id", "m.quality_score", "m.text_len", "m.line_count", F.round("m.short_line_ratio", 6).alias("short_line_ratio"), "m.nav_hits", "m.js_signals", F.col("m.language_hint").alias("lang"))


def g13_document_metrics(spark, d):
    return _docs(spark, d).select("id", "m.quality_score", "m.text_len", "m.line_count", "m.nav_hits")


def p8_p9_quality_gate(spark, d):
    return _docs(spark, d).select("id", T.quality_gate(F.col("text"), F.col("m")).alias("q")).select("id", "q.*")


def p10_p11_scope(spark, d):
    return _pages(spark, d).select("id", T.content_scope(F.col("text")).alias("scope"), T.comments_dynamic(F.col("text"), F.col("m")).alias("dynamic"))


def p12_needs_render(spark, d):
    p = _pages(spark, d).withColumn("q", T.quality_gate(F.col("text"), F.col("m")))
    status = F.when(F.col("id") % 5 == 3, 403).when(F.col("id") % 5 == 4, 503).otherwise(200)
    return p.select("id", T.needs_render(status, F.length("html"), F.col("text"), F.col("m"), F.col("q"), F.lit("auto")).alias("trigger"))


P12_SQL = f"""WITH {PAGE_T}, {METRICS}, {GATE} SELECT id, CASE WHEN reason IS NOT NULL AND reason <> 'BELOW_ACCEPT_THRESHOLD' THEN reason
 WHEN {n_sql('text', C.COMMENT_ITEM)} = 0 AND text_len >= 300 AND regexp_matches(text, {lit('(?i)' + C.COMMENT_DYNAMIC)}) AND {n_sql('text', C.COMMENT_UI)} >= 1 THEN 'comments_likely_dynamic'
 WHEN id % 5 = 3 THEN 'status_403' WHEN text_len < 220 THEN 'text_too_short' WHEN quality_score < force THEN 'quality_too_low' WHEN acceptable THEN NULL WHEN js_signals >= 1 THEN 'js_signal_detected' ELSE coalesce(reason, 'below_accept_threshold') END AS trigger FROM gate"""


def _attempts(spark, d):
    p = _pages(spark, d).withColumn("q", T.quality_gate(F.col("text"), F.col("m")))
    http = p.select(F.col("id").alias("url_key"), F.lit("http").alias("kind"), F.lit(True).alias("fetch_success"), F.when(F.col("id") % 5 == 3, 403).otherwise(200).alias("status_code"), "q.usable", "q.acceptable", F.lit("general").alias("scope"), F.floor(F.col("m.text_len") / 2).alias("text_len"), F.floor(F.col("m.quality_score") / 2).alias("score"))
    js = p.filter("id % 3 > 0").select(F.col("id").alias("url_key"), F.lit("js").alias("kind"), (F.col("id") % 7 > 0).alias("fetch_success"), F.lit(200).alias("status_code"), "q.usable", "q.acceptable", F.lit("general").alias("scope"), F.floor(F.col("m.text_len") * 0.55).alias("text_len"), F.floor(F.col("m.quality_score") * 0.55).alias("score"))
    return http.unionByName(js)


def p13_choose_attempt(spark, d):
    return P.choose_attempt(_attempts(spark, d))


P13_SQL = f"""WITH {PAGE_T}, {METRICS}, {GATE} SELECT id AS url_key, CASE WHEN id % 3 > 0 AND id % 7 > 0 AND usable AND (id % 5 = 3 OR (floor(text_len * 0.55) >= 120 AND floor(text_len * 0.55) >= greatest(180, floor((text_len // 2) * 1.2))) OR floor(quality_score * 0.55) >= quality_score // 2 + 150) THEN 'js' ELSE 'http' END AS chosen FROM gate"""


def p14_choose_extraction(spark, d):
    a = _attempts(spark, d).withColumn("mode", F.when(F.col("kind") == "http", "strict").otherwise("general")).withColumn("text_len", F.when((F.col("kind") == "js") & (F.col("url_key") % 2 == 0), F.col("text_len") * 2).otherwise(F.col("text_len")))
    return P.choose_extraction(a)


P14_SQL = f"""WITH {PAGE_T}, {METRICS}, {GATE} SELECT id AS url_key, CASE WHEN id % 3 > 0 AND usable AND NOT acceptable AND CASE WHEN id % 2 = 0 THEN floor(text_len * 0.55) * 2 ELSE floor(text_len * 0.55) END >= greatest(240, floor((text_len // 2) * 1.45)) THEN 'general' ELSE 'strict' END AS chosen FROM gate"""
MESSAGES_ = ("Executable doesn't exist at /x", "Just a moment...", "net::ERR_TIMED_OUT")


def p16_errors(spark, d):
    log = table(spark, d, "crawl_log").withColumn("message", F.get(F.array(*map(F.lit, MESSAGES_)), (F.col("page_id") % 3).cast("int")))
    code = F.get(F.array(F.lit("net::ERR_timed out"), F.lit(" -- "), F.lit("JS_CRAWL_ERROR"), F.lit(None).cast("string"), F.lit("")), (F.col("page_id") % 5).cast("int"))
    return P.classify_errors(log.withColumn("error_code", code))


def g7_crawl_stats(spark, d):
    return P.crawl_stats(table(spark, d, "crawl_log"))


def p17_social_fallback(spark, d):
    return P.needs_social_fallback(P.crawl_stats(table(spark, d, "crawl_log")).select("research_id", F.col("used_pdf").alias("pages"), F.col("total").alias("selected")))


def g14_noise(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"), T.extract_title(F.col("html")).alias("title")).select("page_id", P.noise_penalty(F.col("text"), F.col("title")).alias("penalty"))


#: penalty of (id, title, l) rows named a.
NOISE = f"""b AS (SELECT *, array_to_string(l[1:10], chr(10)) AS head, array_to_string(l[greatest(len(l) - 19, 1):], chr(10)) AS tail FROM a),
noise AS (SELECT id, CASE WHEN len(l) = 0 THEN 0 ELSE least({n_sql('head', P.LEADING_UI)} * 220, 1320) + least({n_sql('tail', P.TRAILING)} * 280, 1120) + least({n_sql('head', r'(?:^|' + chr(92) + 'n)' + chr(92) + 's*[-|>/]+' + chr(92) + 's*')} * 120, 360)
 + CASE WHEN l[1] NOT LIKE '#%' AND lower(l[1]) = lower(trim(title)) THEN 120 ELSE 0 END + CASE WHEN len(list_filter(l[1:6], lambda x: length(x) <= 24)) >= 4 THEN 260 ELSE 0 END END AS penalty FROM b)"""
G14_SQL = f"WITH {PAGE_T}, ti AS ({F19_SQL}), a AS (SELECT id, title, {lines_sql('text')} AS l FROM t JOIN ti ON id = page_id), {NOISE} SELECT id AS page_id, penalty FROM noise"
#: Both candidates of a page, the structural one (number 2 * page_id) before the whole page.
C3 = f"""st AS ({F18_ALONE}), ti AS ({F19_SQL}), t AS (SELECT 2 * st.page_id AS id, html, text FROM st JOIN {WHOLE} p ON st.page_id = p.page_id UNION ALL SELECT 2 * page_id + 1, html, {html_text_sql('html')} FROM {WHOLE}),
{METRICS}, {GATE}, a AS (SELECT id, title, {lines_sql('text')} AS l FROM t JOIN ti ON id // 2 = page_id), {NOISE},
sc AS (SELECT gate.*, title, CASE WHEN gate.id % 2 = 1 THEN 'html_fallback' ELSE st.source END AS source, quality_score - penalty + CASE WHEN NOT usable THEN -1200 WHEN gate.id % 2 = 0 THEN 120 ELSE 0 END - CASE WHEN acceptable THEN 0 ELSE 80 END AS score
 FROM gate JOIN noise ON gate.id = noise.id JOIN ti ON gate.id // 2 = ti.page_id JOIN st ON gate.id // 2 = st.page_id),
best AS (SELECT sc.id // 2 AS page_id, title, source, t.text, quality_score, reason, usable FROM sc JOIN t ON sc.id = t.id QUALIFY row_number() OVER (PARTITION BY sc.id // 2 ORDER BY score DESC, sc.id) = 1)"""
SCOPE = f"CASE WHEN {n_sql('text', C.COMMENT_ITEM)} >= 2 THEN 'article_plus_comments' WHEN {n_sql('text', C.COMMENT_UI)} >= 1 THEN 'article_only_or_comment_shell' ELSE 'general' END"
C3_SQL = f"WITH {C3} SELECT page_id, title, source, text, {SCOPE} AS scope, quality_score, reason FROM best"


def f20_links(spark, d):
    return P.extract_links(table(spark, d, "pages"), 20)


HOST_SQL = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
LINKS_SQL = rf"""h AS (SELECT page_id, url, html, '(?is)<a\b[^>]*?href=[''"]([^''"]*)[''"][^>]*>(.*?)</a>' AS p FROM pages), a0 AS (SELECT page_id, url, unnest(regexp_extract_all(html, p, 1)) AS href, unnest(regexp_extract_all(html, p, 2)) AS inner_, generate_subscripts(regexp_extract_all(html, p, 1), 1) AS pos FROM h),
a1 AS (SELECT page_id, pos, trim(href) AS href, inner_, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM a0),
a2 AS (SELECT page_id, pos, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN scheme || ':' || href WHEN href LIKE '/%' THEN origin || href WHEN href = '' OR href LIKE '#%' THEN '' ELSE origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END, '#.*$', '') AS link,
 substring(trim(regexp_replace(regexp_replace(inner_, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 120) AS anchor FROM a1),
a3 AS (SELECT * FROM a2 WHERE regexp_matches(link, '(?i)^https?://') QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1), links AS (SELECT page_id, link, anchor, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS ordinal FROM a3 QUALIFY ordinal <= 20)"""
C7_SQL = f"WITH {LINKS_SQL} SELECT links.* FROM links JOIN pages USING (page_id) WHERE {HOST_SQL.format('link')} = {HOST_SQL.format('url')} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ordinal) <= 10"


def c7_site_map(spark, d):
    return P.site_map(table(spark, d, "pages"), 10)


def _probe(spark, d):
    words = spark.createDataFrame([("tion",), ("ing",), ("ent",)], "keyword string")
    return P.keyword_probe(_pages(spark, d).select("id", "text"), words)


def j5_keyword_probe(spark, d):
    return _probe(spark, d).select("id", "keyword")


def f26_kwic(spark, d):
    return _probe(spark, d).select("id", "keyword", F.posexplode(P.kwic(F.col("text"), F.col("keyword"), 40, 1)).alias("at", "snippet"))


F26_SQL = f"""WITH {PAGE_T}, k AS (SELECT id, text, keyword, strpos(lower(text), keyword) - 1 AS p FROM t, (VALUES ('tion'), ('ing'), ('ent')) v(keyword) WHERE contains(lower(text), keyword)),
s AS (SELECT *, greatest(p - 40, 0) AS l, least(p + length(keyword) + 40, length(text)) AS r FROM k) SELECT id, keyword, 0 AS at, CASE WHEN l > 0 THEN '...' ELSE '' END || substring(text, l + 1, r - l) || CASE WHEN r < length(text) THEN '...' ELSE '' END AS snippet FROM s"""


def g8_probe_stats(spark, d):
    log, hits = table(spark, d, "crawl_log"), _probe(spark, d).groupBy("id").agg(F.count("*").alias("n"))
    joined = log.join(hits, log.page_id == hits.id, "left")
    return joined.groupBy("research_id").agg(F.count_if("success").alias("pages_scanned"), F.count_if(~F.col("success")).alias("pages_failed"), F.coalesce(F.sum(F.when(F.col("success"), F.col("n"))), F.lit(0)).alias("matches_found"))


G8_SQL = f"""WITH {PAGE_T}, h AS (SELECT id, count(*) AS n FROM t, (VALUES ('tion'), ('ing'), ('ent')) v(keyword) WHERE contains(lower(text), keyword) GROUP BY id), c AS ({CRAWL_LOG})
SELECT research_id, count(*) FILTER (success) AS pages_scanned, count(*) FILTER (NOT success) AS pages_failed, coalesce(sum(n) FILTER (success), 0)::BIGINT AS matches_found FROM c LEFT JOIN h ON page_id = id GROUP BY research_id"""


def c8_site_probe(spark, d):
    """Every page as a seed."""
    pages = table(spark, d, "pages")
    words = spark.createDataFrame([(0, "tion"), (1, "ing"), (2, "ent")], "ordinal int, keyword string")
    return P.site_probe(pages, pages, words).withColumn("snippets", F.array_join("snippets", "|"))


def c8_probe_stats(spark, d):
    return P.probe_stats(c8_site_probe(spark, d).withColumn("snippets", F.filter(F.split("snippets", r"\|"), lambda x: x != "")))


def c3_extract_pages(spark, d):
    p = P.extract_pages(table(spark, d, "pages"))
    return p.select("page_id", "title", "source", "text", "scope", "metrics.quality_score", "quality.reason")


def c3_read_pages(spark, d):
    """Pages in the mode that reads them better, with what each of their steps took away."""
    p = read_both(table(spark, d, "pages"))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["step"], s["before"] - s["after"])), " ")
    return p.select("page_id", "mode", "source", "title", "text", "scope", "metrics.quality_score", "quality.usable", "quality.reason", steps.alias("steps"))


def truncate_sql(t: str, limit: int) -> str:
    """The text cut at the last boundary mark of its last 180 characters that keeps 60 %."""
    w, ws = f"substring({t}, {limit - 179}, 180)", "' ' || chr(10)"
    upto = lambda m: f"trim(substring({t}, 1, {limit} - strpos(reverse({w}), reverse({m})) + 1), {ws})"
    marks = ("chr(10) || chr(10)", "'。'", "'. '", "chr(10)", "'，'", "', '", "' '")
    return f"CASE WHEN length({t}) <= {limit} THEN {t} " + " ".join(f"WHEN strpos({w}, {m}) > 0 AND length({upto(m)}) >= {int(limit * 0.6)} THEN {upto(m)}" for m in marks) + f" ELSE rtrim(substring({t}, 1, {limit}), {ws}) END"


def summary_sql(rows: str) -> str:
    """Four best blocks in their order of (page_id, title, text) rows, whose texts hold no links."""
    count = lambda p: f"len(regexp_extract_all(b, {lit(p)}))"
    score = f"CASE WHEN length(b) < 30 THEN -10 ELSE least(length(b), 700) + least({count('[.!?。！？]')} * 45, 360) + least({count(BACK + 'p{Nd}')} * 12, 120) + CASE WHEN b LIKE '#%' THEN 180 ELSE 0 END - least({n_sql('substring(b, 1, 500)', T.NAV)} * 140, 560) END"
    cleaned = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\badvertisement\b', '', 'g'), '[ \t\r]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    return rf"""s0 AS (SELECT page_id, title, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS bl FROM ({rows})),
s1 AS (SELECT page_id, title, len(bl) AS blocks, unnest(bl) AS b, generate_subscripts(bl, 1) AS i FROM s0), s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {score} DESC, i) <= 4),
s3 AS (SELECT page_id, blocks, CASE WHEN trim(title) <> '' THEN '# ' || trim(title) || chr(10) || chr(10) ELSE '' END || string_agg(b, chr(10) || chr(10) ORDER BY i) AS m FROM s2 GROUP BY page_id, blocks, title),
s4 AS (SELECT page_id, blocks, {cleaned} AS m FROM s3), summed AS (SELECT page_id, blocks, {truncate_sql('m', 6000)} AS summary FROM s4)"""


C10_SQL = f"WITH {C3}, {summary_sql('SELECT page_id, title, text FROM best')} SELECT page_id, blocks, summary, {truncate_sql('text', 12000)} AS content, usable FROM summed JOIN best USING (page_id)"
W16_SQL = f"""WITH {summary_sql("SELECT doc_id AS page_id, '' AS title, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text FROM documents")} SELECT * FROM summed"""


def c10_page_report(spark, d):
    p = P.extract_pages(table(spark, d, "pages"))
    return P.summarize_pages(p.select("page_id", "title", "text")).join(p.select("page_id", T.smart_truncate(F.col("text"), 12000).alias("content"), "quality.usable"), "page_id")


def w16_summary(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("").alias("title"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return P.summarize_pages(docs)


def p7_resource_type(spark, d):
    kind = F.when(F.col("page_id") % 4 == 0, "application/pdf").when(F.col("page_id") % 4 == 1, "text/html; charset=utf-8").otherwise("")
    body = F.when(F.col("page_id") % 6 == 5, F.concat(F.lit("%PDF-"), "html")).otherwise(F.col("html")).cast("binary")
    url = F.when(F.col("page_id") % 9 == 2, "https://a.example/x.PDF?y=1").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.resource_type(url, kind, body).alias("resource_type"))


def f21_strip_links(spark, d):
    text = F.concat("url", F.lit(" [a](b) ![i](j) advertisement\r\n\r\n\r\n x [c](javascript:d) "), "url")
    return table(spark, d, "pages").select("page_id", T.strip_md_links(text).alias("text"))


def f24_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.smart_truncate(F.coalesce("text", F.lit("")), 500).alias("text"))


F24_SQL = "SELECT doc_id, CASE WHEN length(t) <= 500 THEN t " + " ".join(f"WHEN strpos(w, {m}) > 0 AND length(trim(substring(t, 1, 500 - strpos(reverse(w), reverse({m})) + 1), ' ' || chr(10))) >= 300 THEN trim(substring(t, 1, 500 - strpos(reverse(w), reverse({m})) + 1), ' ' || chr(10))" for m in ("chr(10) || chr(10)", "'。'", "'. '", "chr(10)", "'，'", "', '", "' '")) + " ELSE rtrim(substring(t, 1, 500), ' ' || chr(10)) END AS text FROM (SELECT doc_id, coalesce(text, '') AS t, substring(coalesce(text, ''), 321, 180) AS w FROM documents)"

QUERIES = {
    "s10_pages": (s10_pages, "SELECT page_id, url, length(html) AS html_len FROM pages"),
    "f17_html_text": (f17_html_text, f"WITH {PAGE_T} SELECT id, text FROM t"),
    "f18_structural_text": (f18_structural, F18_SQL),
    "f19_title": (f19_title, F19_SQL),
    "f16_language_class": (f16_language, """SELECT page_id, CASE WHEN n = '' THEN 'latin' WHEN regexp_matches(n, '^(zh|ja|ko)') THEN 'cjk' WHEN n LIKE 'th%' THEN 'thai' ELSE 'latin' END AS lang FROM (SELECT page_id, lower(regexp_extract(html, '(?i)<html[^>]+lang=[''"]([a-zA-Z-]+)', 1)) AS n FROM pages)"""),
    "g13_content_metrics": (g13_metrics, f"WITH {PAGE_T}, {METRICS} SELECT id, quality_score, text_len, line_count, round(short_line_ratio, 6) AS short_line_ratio, nav_hits, js_signals, lang FROM metrics"),
    "g13_document_metrics": (g13_document_metrics, f"WITH {DOC_T}, {METRICS} SELECT id, quality_score, text_len, line_count, nav_hits FROM metrics"),
    "p8_p9_quality_gate": (p8_p9_quality_gate, f"WITH {DOC_T}, {METRICS}, {GATE} SELECT id, usable, acceptable, reason FROM gate"),
    "p10_p11_scope": (p10_p11_scope, f"WITH {PAGE_T}, {METRICS} SELECT id, CASE WHEN {n_sql('text', C.COMMENT_ITEM)} >= 2 THEN 'article_plus_comments' WHEN {n_sql('text', C.COMMENT_UI)} >= 1 THEN 'article_only_or_comment_shell' ELSE 'general' END AS scope, {n_sql('text', C.COMMENT_ITEM)} = 0 AND text_len >= 300 AND regexp_matches(text, {lit('(?i)' + C.COMMENT_DYNAMIC)}) AND {n_sql('text', C.COMMENT_UI)} >= 1 AS dynamic FROM metrics"),
    "p12_needs_render": (p12_needs_render, P12_SQL),
    "p13_choose_attempt": (p13_choose_attempt, P13_SQL),
    "p14_choose_extraction": (p14_choose_extraction, P14_SQL),
    "p16_error_class": (p16_errors, f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'JS_BROWSER_MISSING' WHEN 1 THEN 'JS_ANTI_BOT_BLOCKED' ELSE 'JS_CRAWL_ERROR' END AS error_class, ['NET_ERR_TIMED_OUT', 'EXTRACT_EMPTY', 'JS_CRAWL_ERROR', 'EXTRACT_EMPTY', 'EXTRACT_EMPTY'][page_id % 5 + 1] AS error_label, status_code IN (408, 425, 429, 500, 502, 503, 504) AS retryable FROM ({CRAWL_LOG})"),
    "p17_social_fallback": (p17_social_fallback, f"SELECT *, pages < 6 OR (selected >= 6 AND pages < greatest(2, selected // 2)) AS fallback FROM (SELECT research_id, count(*) FILTER (success AND resource_type = 'pdf') AS pages, count(*) AS selected FROM ({CRAWL_LOG}) GROUP BY research_id)"),
    "p7_resource_type": (p7_resource_type, "SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'pdf' WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'html' WHEN page_id % 9 = 2 THEN 'pdf' ELSE 'other' END AS resource_type FROM pages"),
    "g7_crawl_stats": (g7_crawl_stats, f"SELECT research_id, count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, count(*) FILTER (success AND used_render = 'js') AS used_js, count(*) FILTER (success AND resource_type = 'pdf') AS used_pdf FROM ({CRAWL_LOG}) GROUP BY research_id"),
    "g14_noise_penalty": (g14_noise, G14_SQL),
    "f20_links": (f20_links, f"WITH {LINKS_SQL} SELECT * FROM links"),
    "c7_j10_site_map": (c7_site_map, C7_SQL),
    "j5_keyword_probe": (j5_keyword_probe, f"WITH {PAGE_T} SELECT id, keyword FROM t, (VALUES ('tion'), ('ing'), ('ent')) v(keyword) WHERE contains(lower(text), keyword)"),
    "f26_kwic": (f26_kwic, F26_SQL),
    "g8_c8_probe_stats": (g8_probe_stats, G8_SQL),
    "c8_site_probe": (c8_site_probe, None),
    "c8_probe_stats": (c8_probe_stats, None),
    "c3_read_pages": (c3_read_pages, None),
    "c3_w17_extract_pages": (c3_extract_pages, C3_SQL),
    "c10_page_report": (c10_page_report, C10_SQL),
    "w16_summary": (w16_summary, W16_SQL),
    "f21_strip_links": (f21_strip_links, "SELECT page_id, trim(url || ' a' || chr(10) || chr(10) || 'x c ' || url) AS text FROM (SELECT page_id, url FROM pages)"),
    "f24_smart_truncate": (f24_truncate, F24_SQL),
}
