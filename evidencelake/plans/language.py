"""Registered queries on query language, query plans, text repair and handlers by site."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleanup as U
from ..functions import querylang as L
from ..functions import text as T
from ..functions import urls
from ..operators import trimming as M
from ..sources.handlers import apply_handlers
from ..sources.tables import table

#: Put before texts, so that all scripts and hints occur.
LEADS = ("台灣 房價 ", "東京の天気 ", "한국 뉴스 ", "ㄅㄆ ", "如何 使用 Python API 教學 ", "usa weather ", "", "这为应 门 ")
SAID = f"""q AS (SELECT conv_id AS research_id, turn AS query_ordinal, {list(LEADS)}[(conv_id + turn) % {len(LEADS)} + 1] || coalesce(text, '') AS query FROM conversations)"""


def _led(spark, d):
    """Every message as a query of its conversation."""
    lead = F.get(F.array(*map(F.lit, LEADS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(LEADS))).cast("int"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("research_id"), F.col("turn").alias("query_ordinal"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("query"), F.lit("").alias("question"))


def _any(words, text="lower(query)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _n(pattern, text="query"):
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _named(word, text):
    if all(c.isascii() and c != " " for c in word):
        return f"regexp_matches(lower({text}), '(^|[^a-z0-9]){word.replace('.', '[.]')}([^a-z0-9]|$)')"
    return _any((word,), f"lower({text})")


def _code(codes, key):
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in codes.items()) + " END"


def _hint_sql(text="query"):
    return "CASE " + " ".join(f"WHEN {' OR '.join(_named(w, text) for w in words)} THEN '{code}'" for code, words in L.COUNTRY_HINTS.items()) + " END"


def _more_sql(text="query"):
    trad, simp = _n(f"[{L.TRADITIONAL}]", text), _n(f"[{L.SIMPLIFIED}]", text)
    return f"CASE WHEN {trad} > {simp} THEN '{{}}' WHEN {simp} > {trad} THEN '{{}}' END"


def _lang_sql(text="query", country="country"):
    region = _code(L.REGION_LANG, country)
    return f"CASE WHEN {_n(L.KANA, text)} > 0 THEN 'ja' WHEN {_n(L.HANGUL, text)} > 0 THEN 'ko' WHEN {_n(L.BOPOMOFO, text)} > 0 THEN 'zh-hant' WHEN {_n(L.HAN, text)} > 0 THEN coalesce({region}, {_more_sql(text).format('zh-hant', 'zh-hans')}) WHEN {_n(L.LATIN, text)} > 0 THEN 'en' END"


LOCAL_SQL = f"((coalesce(country, '') IN ('TW', 'CN', 'JP', 'KR', 'GB') AND {_any(L.LOCAL_HINTS)}) OR {_any(('near me', '附近'))})"
GLOBAL_SQL = f"({_any(L.GLOBAL_HINTS)} OR {_n(L.LATIN)} >= 2)"


def f10_f13_flags(spark, d):
    t = F.col("query")
    q = _led(spark, d).withColumn("country", L.country_hint(t))
    return q.select("research_id", "query_ordinal", "country", L.query_lang(t, F.col("country")).alias("lang"), L.is_local_query(t, F.col("country")).alias("local"), L.is_global_topic(t).alias("worldwide"), L.script_flags(t).alias("s")).select("research_id", "query_ordinal", "country", "lang", "local", "worldwide", "s.*")


F10_SQL = f"""WITH {SAID}, c AS (SELECT *, {_hint_sql()} AS country FROM q) SELECT research_id, query_ordinal, country, {_lang_sql()} AS lang, {LOCAL_SQL} AS local, {GLOBAL_SQL} AS worldwide,
 {_n(L.HAN)} > 0 AS han, {_n(L.KANA)} > 0 AS kana, {_n(L.HANGUL)} > 0 AS hangul, {_n(L.BOPOMOFO)} > 0 AS bopomofo, {_n(L.HAN)}::INT AS n_han FROM c"""


def _mirror_sql():
    t = "query"
    for phrase, english in L.MIRROR:
        t = f"replace({t}, '{phrase}', ' {english} ')"
    words = f"list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z0-9][A-Za-z0-9._:+/#-]*'), lambda x: regexp_replace(x, '^:+|:+$', '', 'g')), lambda x: length(x) >= 2)"
    return f"nullif(array_to_string(list_filter({words}, lambda x, i: list_position(list_transform({words}, lambda y: lower(y)), lower(x)) = i)[1:12], ' '), '')"


F14_SQL = f"WITH {SAID} SELECT research_id, query_ordinal, {_mirror_sql()} AS mirror FROM q"


def f14_mirror(spark, d):
    return _led(spark, d).select("research_id", "query_ordinal", L.english_mirror(F.col("query")).alias("mirror"))


def g3_profile(spark, d):
    return L.query_profile(_led(spark, d))


G3_SQL = f"""WITH {SAID}, t AS (SELECT research_id, ' ' || string_agg(query, ' ' ORDER BY query_ordinal) AS query FROM q GROUP BY research_id), k AS (SELECT *, {_n(L.LATIN)} >= 3 AND {_n(L.HAN)} <= 10 AS technical FROM t),
c AS (SELECT *, coalesce({_hint_sql()}, CASE WHEN {_n(L.BOPOMOFO)} > 0 THEN 'TW' WHEN {_n(L.KANA)} > 0 THEN 'JP' WHEN {_n(L.HANGUL)} > 0 THEN 'KR' WHEN {_n(L.HAN)} > 0 AND NOT technical THEN {_more_sql().format('TW', 'CN')} END, 'US') AS country FROM k)
SELECT research_id, country, CASE WHEN technical THEN 'en' ELSE {_lang_sql()} END AS search_lang, {GLOBAL_SQL} AS is_global_topic FROM c"""

SOURCES = [{"api": "brave", "query_suffix": "site:reddit.com"}, {"api": "tavily"}, {"api": "exa"}, {"api": "serpapi_google"}, {"api": "serpapi_google_scholar"}]


def f15_plans(spark, d):
    q = _led(spark, d)
    return L.plan_queries(q, L.query_profile(q), SOURCES)


def _part(name, value):
    return f"""'"{name}":"' || {value} || '"'"""


APIS = f"s AS (SELECT * FROM (VALUES {', '.join(str((i, x['api'], x.get('query_suffix', ''))) for i, x in enumerate(SOURCES))}) v(source_ordinal, api, suffix))"
FOREIGN = " OR ".join(f"{_n(x)} > 0" for x in (L.HAN, L.KANA, L.HANGUL, L.BOPOMOFO))
F15_SQL = f"""WITH p AS ({G3_SQL}), {SAID.replace("q AS", "q0 AS")}, q AS (SELECT research_id, query_ordinal, trim(query) AS query FROM q0),
f AS (SELECT q.*, p.country AS home, p.search_lang AS home_lang, {FOREIGN} AS alien FROM q JOIN p ON q.research_id = p.research_id),
c AS (SELECT *, coalesce({_hint_sql()}, CASE WHEN {GLOBAL_SQL} AND (NOT alien OR ({_n(L.LATIN)} >= 3 AND {_n(L.HAN)} <= 8)) THEN 'US' END, home) AS country FROM f),
l AS (SELECT *, coalesce({_lang_sql()}, CASE WHEN NOT alien THEN home_lang END) AS search_lang, CASE WHEN query <> '' AND NOT {LOCAL_SQL} AND {GLOBAL_SQL} AND alien THEN {_mirror_sql()} END AS english_mirror FROM c), {APIS}
SELECT research_id, query_ordinal, source_ordinal, api, concat_ws(' ', CASE WHEN api = 'exa' THEN english_mirror END, query, nullif(suffix, '')) AS effective_query, country, search_lang, english_mirror,
 '{{' || concat_ws(',', CASE api WHEN 'brave' THEN {_part('country', 'country')} WHEN 'tavily' THEN {_part('country', _code(L.TAVILY_COUNTRY, 'country'))} END,
 CASE WHEN api = 'brave' THEN {_part('search_lang', "CASE search_lang WHEN 'ja' THEN 'jp' ELSE search_lang END")} END, CASE WHEN api = 'serpapi_google' THEN {_part('gl', 'lower(country)')} END,
 CASE WHEN api LIKE 'serpapi_google%' THEN {_part('hl', f"coalesce({_code(L.GOOGLE_HL, 'search_lang')}, {_code(L.COUNTRY_HL, 'country')})")} END, CASE WHEN api = 'exa' THEN {_part('user_location', 'country')} END) || '}}' AS params FROM l, s"""


def f1_sanitize(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " &amp;amp; ﬁ ​Ａ").otherwise("")).alias("text"))
    return U.sanitize(docs, "text")


#: The texts hold nothing else that normalisation changes.
F1_SQL = r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ltrim(t || ' & fi A', ' ' || chr(10)) ELSE trim(t, ' ' || chr(10)) END AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)"""


def f2_decode(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.regexp_replace("text", "[^\\x00-ÿ]", "?"), "ISO-8859-1")).alias("body"), F.when(F.col("doc_id") % 2 == 0, "text/html; charset=utf-8").otherwise("text/html; charset=iso-8859-1").alias("content_type"))
    return U.decode_body(docs).select("doc_id", "text")


def p22_garbled(spark, d):
    bad = F.concat(F.lit("Ã©Ã¨Ã¢\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", U.drop_garbled_lines(bad).alias("text"))


def x2_handlers(spark, d):
    pages = table(spark, d, "pages")
    forum = (urls.url_domain(F.col("url")).contains("blog"), lambda df: df.withColumn("text", F.lit("blog")))
    plain = (F.col("page_id") % 2 == 0, lambda df: df.withColumn("text", F.concat(F.lit("even "), "page_id")))
    return apply_handlers(pages, [forum, plain], lambda df: df.withColumn("text", F.lit("default"))).select("page_id", "text")


def _trimmed(spark, d):
    pages = table(spark, d, "pages")
    tail = F.when(F.col("page_id") % 2 == 0, "\nShort note\nRead more\nOther story").otherwise("")
    return M.postprocess(pages.select("page_id", F.concat(F.lit("Sign in\n"), T.html_to_text(F.col("html")), tail).alias("text"), T.extract_title(F.col("html")).alias("title")))


def f22_f23_trimmed(spark, d):
    return _trimmed(spark, d).select("page_id", "text")


def f23_clean_content(spark, d):
    """Pages with their navigation as lines of text before their own."""
    shell = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style|head)\\b[^>]*>.*?</\\1\\s*>", ""), "(?s)<[^>]+>", "\n")
    pages = table(spark, d, "pages").select("page_id", "url", F.array_join(T.lines_of(shell), "\n").alias("text"), T.extract_title(F.col("html")).alias("title"))
    return M.clean_content(U.sanitize(pages, "text")).select("page_id", "text")


def g16_step_stats(spark, d):
    return M.clean_step_stats(_trimmed(spark, d))


QUERIES = {
    "f22_f23_trimmed": (f22_f23_trimmed, None),
    "f23_clean_content": (f23_clean_content, None),
    "g16_step_stats": (g16_step_stats, None),
    "f10_f13_query_flags": (f10_f13_flags, F10_SQL),
    "f14_english_mirror": (f14_mirror, F14_SQL),
    "g3_query_profile": (g3_profile, G3_SQL),
    "f15_query_plans": (f15_plans, F15_SQL),
    "f1_sanitize": (f1_sanitize, F1_SQL),
    "f2_x1_decode": (f2_decode, "SELECT doc_id, text FROM documents"),
    "p22_garbled_lines": (p22_garbled, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "x2_site_handlers": (x2_handlers, "SELECT page_id, CASE WHEN lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) LIKE '%blog%' THEN 'blog' WHEN page_id % 2 = 0 THEN 'even ' || page_id ELSE 'default' END AS text FROM pages"),
}
