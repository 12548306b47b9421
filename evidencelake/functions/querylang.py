"""Script tests, country and language of queries, and query plans of sources, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import ordered

# Fixed word lists and codes, as results depend on them.
COUNTRY_HINTS = {
    "TW": ("台灣", "臺灣", "taiwan", "taipei", "台北", "臺北", "高雄", "taichung"),
    "CN": ("中國", "中国", "大陸", "大陆", "china", "beijing", "shanghai", "深圳"),
    "US": ("美國", "美国", "usa", "u.s.", "united states", "new york", "california", "矽谷"),
    "JP": ("日本", "japan", "tokyo", "東京", "大阪", "osaka", "京都", "kyoto"),
    "KR": ("韓國", "韩国", "south korea", "korea", "seoul", "首爾", "首尔"),
    "GB": ("英國", "英国", "uk", "u.k.", "united kingdom", "britain", "london", "倫敦"),
}
LOCAL_HINTS = ("票價", "票价", "房價", "房价", "門市", "门市", "地址", "交通", "捷運", "捷运", "餐廳", "餐厅", "政府", "法規", "法规", "報稅", "报税", "學區", "学区", "附近", "營業時間", "营业时间", "門診")
GLOBAL_HINTS = ("api", "sdk", "github", "gitlab", "python", "javascript", "typescript", "rust", "go", "java", "react", "next.js", "node", "docker", "kubernetes", "postgres", "mysql", "redis", "openai", "gemini", "claude", "llm", "ai", "saas", "benchmark", "pricing", "release notes", "changelog")
TRADITIONAL = "體臺網頁資處這為與發應從點請設啟總層價門會學術業實機"
SIMPLIFIED = "体台网页资处这为与发应从点请设启总层价门会学术业实机"
REGION_LANG = {"TW": "zh-hant", "HK": "zh-hant", "MO": "zh-hant", "CN": "zh-hans", "SG": "zh-hans"}
TAVILY_COUNTRY = {"TW": "taiwan", "CN": "china", "US": "united states", "JP": "japan", "KR": "south korea", "GB": "united kingdom", "CA": "canada", "AU": "australia", "SG": "singapore", "HK": "hong kong"}
BRAVE_LANGS = (
    "ar", "eu", "bn", "bg", "ca", "zh-hans", "zh-hant", "hr", "cs", "da", "nl", "en", "en-gb", "et", "fi", "fr", "gl", "de", "el", "gu", "he", "hi", "hu", "is", "it", "jp", "kn",
    "ko", "lv", "lt", "ms", "ml", "mr", "nb", "pl", "pt-br", "pt-pt", "pa", "ro", "ru", "sr", "sk", "sl", "es", "sv", "ta", "te", "th", "tr", "uk", "vi",
)
BRAVE_ALIASES = {"ja": "jp", "ja-jp": "jp", "jp-jp": "jp", "ko-kr": "ko", "zh": "zh-hans", "zh-cn": "zh-hans", "zh-sg": "zh-hans", "zh-tw": "zh-hant", "zh-hk": "zh-hant", "zh-mo": "zh-hant"}
GOOGLE_HL = {"zh-hant": "zh-TW", "zh-hans": "zh-CN", "ja": "ja", "ko": "ko", "en": "en"}
COUNTRY_HL = {"TW": "zh-TW", "HK": "zh-TW", "MO": "zh-TW", "CN": "zh-CN", "JP": "ja", "KR": "ko", "US": "en", "GB": "en", "CA": "en", "AU": "en"}
MIRROR = (
    ("官方文件", "official documentation"), ("最佳實踐", "best practices"), ("最佳实践", "best practices"),
    ("使用方法", "usage"), ("如何", "how to"), ("怎麼", "how to"), ("怎么", "how to"),
    ("教學", "tutorial"), ("教程", "tutorial"), ("指南", "guide"), ("範例", "examples"), ("示例", "examples"),
    ("比較", "comparison"), ("差異", "differences"), ("優缺點", "pros cons"), ("优缺点", "pros cons"),
    ("原理", "principles"), ("架構", "architecture"), ("架构", "architecture"), ("功能", "features"),
    ("限制", "limitations"), ("價格", "pricing"), ("价格", "pricing"), ("費用", "cost"), ("费用", "cost"),
    ("效能", "performance"), ("性能", "performance"), ("速度", "speed"), ("測試", "benchmark"), ("测试", "benchmark"),
    ("更新", "update"), ("最新", "latest"), ("版本", "version"), ("發佈", "release"), ("发布", "release"),
    ("錯誤", "error"), ("错误", "error"), ("問題", "issue"), ("无法", "cannot"), ("無法", "cannot"),
    ("失敗", "failed"), ("失败", "failed"), ("修復", "fix"), ("修复", "fix"), ("原因", "cause"),
    ("支援", "support"), ("支持", "support"), ("相容", "compatibility"), ("兼容", "compatibility"),
)
DEFAULT_COUNTRY = "US"
HAN, KANA, HANGUL, BOPOMOFO = "[㐀-䶿一-鿿]", "[぀-ヿ]", "[ᄀ-ᇿ㄰-㆏가-힯]", "[㄀-ㄯㆠ-ㆿ]"
LATIN = "[A-Za-z][A-Za-z0-9._:+/#-]+"


def _map(codes: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in codes.items() for x in p))[key]


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def brave_lang(lang: Column) -> Column:
    """The language code that Brave's API takes, or null if it knows none: an alias, the code itself, or its first part."""
    code = F.replace(F.lower(F.trim(lang)), F.lit("_"), F.lit("-"))
    base = F.split_part(code, F.lit("-"), F.lit(1))
    return F.coalesce(_map(BRAVE_ALIASES, code), F.when(code.isin(*BRAVE_LANGS), code), F.when(base.isin(*BRAVE_LANGS), base))


def script_flags(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.rlike(HAN).alias("han"), t.rlike(KANA).alias("kana"), t.rlike(HANGUL).alias("hangul"), t.rlike(BOPOMOFO).alias("bopomofo"), _n(t, HAN).alias("n_han"))


def country_hint(text: Column) -> Column:
    """The first country, in fixed order, of which a name is in the text; Latin names as whole words."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def named(word: str) -> Column:
        if all(c.isascii() and c != " " for c in word):
            return t.rlike(rf"(?<![a-z0-9])\Q{word}\E(?![a-z0-9])")
        return t.contains(word)

    return F.coalesce(*(F.when(reduce(lambda a, b: a | b, map(named, words)), code) for code, words in COUNTRY_HINTS.items()))


def query_lang(text: Column, country: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    trad, simp = _n(t, f"[{TRADITIONAL}]"), _n(t, f"[{SIMPLIFIED}]")
    return (
        F.when(t.rlike(KANA), "ja").when(t.rlike(HANGUL), "ko").when(t.rlike(BOPOMOFO), "zh-hant")
        .when(t.rlike(HAN), F.coalesce(_map(REGION_LANG, F.upper(F.coalesce(country, F.lit("")))), F.when(trad > simp, "zh-hant").when(simp > trad, "zh-hans")))
        .when(t.rlike(LATIN), "en")
    )


def is_global_topic(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (t.contains(w) for w in GLOBAL_HINTS)) | (_n(F.coalesce(text, F.lit("")), LATIN) >= 2)


def is_local_query(text: Column, country: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    hinted = reduce(lambda a, b: a | b, (t.contains(w) for w in LOCAL_HINTS))
    return (F.coalesce(country.isin("TW", "CN", "JP", "KR", "GB"), F.lit(False)) & hinted) | t.contains("near me") | t.contains("附近")


def english_mirror(text: Column) -> Column:
    """Known phrases in English and the Latin tokens, distinct in any case, at most 12; null if there is none."""
    t = F.trim(F.coalesce(text, F.lit("")))
    for phrase, english in MIRROR:
        t = F.replace(t, F.lit(phrase), F.lit(f" {english} "))
    tokens = F.filter(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9][A-Za-z0-9._:+/#-]*"), 0), lambda x: F.regexp_replace(x, "^[:]+|[:]+$", "")), lambda x: F.length(x) >= 2)
    once = F.element_at(F.transform(F.array(tokens), lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: F.lower(y)), F.lower(x)) == i + 1)), 1)
    return F.nullif(F.array_join(F.slice(once, 1, 12), " "), F.lit(""))


def query_profile(queries: DataFrame) -> DataFrame:
    """research_id, country, search_lang, is_global_topic from the question and queries (research_id, question, query_ordinal, query)."""
    corpus = queries.groupBy("research_id").agg(F.concat_ws(" ", F.max("question"), F.array_join(ordered(F.col("query"), ["query_ordinal"]), " ")).alias("t"))
    t = F.col("t")
    trad, simp = _n(t, f"[{TRADITIONAL}]"), _n(t, f"[{SIMPLIFIED}]")
    technical = (_n(t, LATIN) >= 3) & (_n(t, HAN) <= 10)
    by_script = F.when(t.rlike(BOPOMOFO), "TW").when(t.rlike(KANA), "JP").when(t.rlike(HANGUL), "KR").when(t.rlike(HAN) & ~technical, F.when(trad > simp, "TW").when(simp > trad, "CN"))
    placed = corpus.withColumn("country", F.coalesce(country_hint(t), by_script, F.lit(DEFAULT_COUNTRY)))
    return placed.select("research_id", "country", F.when(technical, "en").otherwise(query_lang(t, F.col("country"))).alias("search_lang"), is_global_topic(t).alias("is_global_topic"))


def plan_queries(queries: DataFrame, profiles: DataFrame, sources: list[dict], search_mode: str = "web") -> DataFrame:
    """One row a query and source (ordinal, api, suffix): effective query, country, language and the source's own parameters."""
    src = F.array(*(F.struct(F.lit(i).alias("source_ordinal"), F.lit(s["api"]).alias("api"), F.lit(s.get("query_suffix", "")).alias("suffix"), F.lit(s.get("search_depth", "basic")).alias("depth")) for i, s in enumerate(sources)))
    each = queries.join(profiles.withColumnRenamed("country", "home").withColumnRenamed("search_lang", "home_lang"), "research_id")
    q = F.trim(F.coalesce("query", F.lit("")))
    foreign = q.rlike(f"{HAN}|{KANA}|{HANGUL}|{BOPOMOFO}")
    worldly = is_global_topic(q) & (~foreign | ((_n(q, LATIN) >= 3) & (_n(q, HAN) <= 8)))
    each = each.withColumn("country", F.coalesce(country_hint(q), F.when(worldly, DEFAULT_COUNTRY), F.col("home")))
    each = each.withColumn("search_lang", F.coalesce(query_lang(q, F.col("country")), F.when(~foreign, F.col("home_lang"))))
    mirrored = F.when((q != "") & F.lit(search_mode != "social") & ~is_local_query(q, F.col("country")) & is_global_topic(q) & foreign, english_mirror(q))
    # what goes by the query alone is computed before its sources stand beside it
    each = each.withColumn("english_mirror", mirrored).withColumn("s", F.explode(src))
    mirrored = F.col("english_mirror")
    api, c, lang = F.col("s.api"), F.col("country"), F.col("search_lang")
    hl = F.coalesce(_map(GOOGLE_HL, lang), _map(COUNTRY_HL, c))
    params = F.to_json(F.struct(
        F.when(api == "brave", c).when((api == "tavily") & ~F.col("s.depth").isin("fast", "ultra-fast"), _map(TAVILY_COUNTRY, c)).alias("country"), F.when(api == "brave", brave_lang(lang)).alias("search_lang"),
        F.when(api.isin("serpapi_google", "serpapi_google_forums"), F.lower(c)).alias("gl"), F.when(api.startswith("serpapi_google"), hl).alias("hl"), F.when(api == "exa", c).alias("user_location"),
    ))
    effective = F.concat_ws(" ", F.when(api == "exa", mirrored), q, F.nullif(F.col("s.suffix"), F.lit("")))
    return each.select("research_id", "query_ordinal", "s.source_ordinal", "s.api", effective.alias("effective_query"), "country", "search_lang", "english_mirror", params.alias("params"))
