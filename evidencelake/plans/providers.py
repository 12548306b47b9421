"""Registered queries on archived responses, prompts and replies, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import judging as J
from ..operators import selection as S
from ..sources import providers as P
from ..sources.tables import QUESTIONS, SERP, table
from .chunks import CHUNKS, _chunks
from .serp import MERGED, Q_SQL, _merged, _queries


def _raw(spark, d, item, path):
    """Archived responses made of the result rows: one JSON text for each query and lane."""
    rows = table(spark, d, "serp").groupBy("research_id", "query_ordinal", "source_ordinal").agg(S.ordered(item, ["position"]).alias("a"))
    body = F.col("a")
    for name in reversed(path):
        body = F.struct(body.alias(name))
    return rows.select("research_id", "query_ordinal", "source_ordinal", F.to_json(body).alias("body"))


def _flat(df):
    return df.select("research_id", "query_ordinal", "source_ordinal", "position", "title", "url", "content", "engine", F.round("relevance_score", 6).alias("relevance_score"), "published_date")


def _sql(engine, content, score, date, cap):
    return f"WITH s AS ({SERP}) SELECT research_id, query_ordinal, source_ordinal, position, trim(title) AS title, url, {content} AS content, '{engine}' AS engine, {score} AS relevance_score, {date} AS published_date FROM s WHERE position <= {cap}"


def s1_searxng(spark, d):
    item = F.struct("title", "url", "content", F.array("engine").alias("engines"), (F.col("position") / 10).alias("score"), F.col("published_date").alias("publishedDate"))
    return _flat(P.normalize_searxng(_raw(spark, d, item, ["results"])))


def s2_brave(spark, d):
    return _flat(P.normalize_brave(_raw(spark, d, F.struct("title", "url", F.col("content").alias("description"), F.array(F.lit("one"), F.lit(""), F.lit("two")).alias("extra_snippets"), F.col("published_date").alias("age")), ["web", "results"])))


def s3_tavily(spark, d):
    return _flat(P.normalize_tavily(_raw(spark, d, F.struct("title", "url", "content", (F.col("position") / 7).alias("score")), ["results"])))


def s4_exa(spark, d):
    item = F.struct("title", "url", F.concat(F.lit("text "), "title").alias("text"), F.when(F.col("position") % 2 == 0, F.array(F.lit("h1"), F.lit("h2"))).alias("highlights"), F.when(F.col("position") % 2 == 0, F.array(F.lit(0.25), F.col("position") / 4)).alias("highlightScores"))
    return _flat(P.normalize_exa(_raw(spark, d, item, ["results"])))


def s5_google(spark, d):
    return _flat(P.normalize_serp_google(_raw(spark, d, F.struct("title", F.col("url").alias("link"), F.col("content").alias("snippet"), F.col("published_date").alias("date")), ["organic_results"])))


def s6_scholar(spark, d):
    item = F.struct("title", F.col("url").alias("link"), F.col("content").alias("snippet"), F.struct(F.concat(F.lit("A B - J, "), F.col("position") + 1990).alias("summary")).alias("publication_info"), F.struct(F.struct((F.col("position") - 1).alias("total")).alias("cited_by")).alias("inline_links"))
    return _flat(P.normalize_serp_scholar(_raw(spark, d, item, ["organic_results"])))


def s7_forums(spark, d):
    return _flat(P.normalize_serp_forums(_raw(spark, d, F.struct("title", F.col("url").alias("link"), F.col("content").alias("snippet"), F.lit("site").alias("source")), ["organic_results"])))


CUSTOM = {"id": "mine", "result_path": "payload.0.items", "fields": {"title": "headline", "url": "links.0", "content": "meta.abstract"}, "max_results": 4}


def s8_custom(spark, d):
    item = F.struct(F.col("title").alias("headline"), F.array("url").alias("links"), F.struct(F.col("content").alias("abstract")).alias("meta"), (F.col("position") * 2).alias("score"))
    rows = table(spark, d, "serp").groupBy("research_id", "query_ordinal", "source_ordinal").agg(S.ordered(item, ["position"]).alias("items"))
    raw = rows.select("research_id", "query_ordinal", "source_ordinal", F.to_json(F.struct(F.array(F.struct("items")).alias("payload"))).alias("body"))
    return _flat(P.normalize_custom(raw, CUSTOM))


def x3_read_serp(spark, d):
    """Archived responses of three providers in one table; one declared provider is off, one does not serve the mode."""
    item = F.struct("title", "url", "content", F.col("content").alias("description"), (F.col("position") / 7).alias("score"))
    raw = _raw(spark, d, item, ["results"])
    rows = raw.withColumn("provider", F.get(F.array(*map(F.lit, ("searxng", "tavily", "mine", "off", "social"))), F.pmod(F.col("research_id") + F.col("query_ordinal"), F.lit(5)).cast("int")))
    custom = [{"id": "mine", "max_results": 2}, {"id": "off", "enabled": False}, {"id": "social", "modes": ["social"]}]
    return P.read_serp(rows, custom, mode="web").select("research_id", "query_ordinal", "source_ordinal", "position", "url", "engine")


X3_SQL = f"""WITH s AS ({SERP}), p AS (SELECT *, ['searxng', 'tavily', 'mine', 'off', 'social'][(research_id + query_ordinal) % 5 + 1] AS provider FROM s)
SELECT research_id, query_ordinal, source_ordinal, position, url, provider AS engine FROM p WHERE position <= CASE provider WHEN 'searxng' THEN 30 WHEN 'tavily' THEN 20 WHEN 'mine' THEN 2 ELSE 0 END"""


def s12_threads(spark, d):
    c = table(spark, d, "conversations")
    child = F.struct(F.when(F.col("role") == "system", "more").otherwise("t1").alias("kind"), F.struct(F.col("role").alias("author"), F.col("text").alias("body"), F.col("turn").alias("score")).alias("data"))
    talks = c.groupBy("conv_id").agg(S.ordered(child, ["turn"]).alias("comments"))
    post = F.struct(F.lit("t3").alias("kind"), F.struct(F.concat(F.lit("Topic "), "conv_id").alias("title"), F.lit("me").alias("author"), F.lit(3).alias("score"), F.lit(0.9).alias("upvote_ratio"), F.size("comments").alias("num_comments"), F.lit("sub").alias("subreddit"), F.lit("self text").alias("selftext")).alias("data"))
    listing = lambda kids: F.to_json(F.struct(F.struct(kids.alias("children")).alias("data")))
    raw = talks.select(F.col("conv_id").cast("string").alias("thread_key"), F.concat(F.lit("["), listing(F.array(post)), F.lit(","), listing(F.col("comments")), F.lit("]")).alias("body"))
    return P.flatten_threads(raw)


S12_SQL = r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role <> 'system' AND coalesce(text, '') NOT IN ('', '[deleted]', '[removed]') AS spoken FROM conversations),
k AS (SELECT * FROM c QUALIFY NOT spoken OR row_number() OVER (PARTITION BY conv_id, spoken ORDER BY i) <= 50), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, string_agg('**u/' || role || '** (Score: ' || turn || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY i) FILTER (spoken) AS said FROM k GROUP BY conv_id),
t AS (SELECT conv_id, '# Topic ' || conv_id || chr(10) || '**r/sub** | u/me | Score: 3 (90% upvoted) | ' || n || ' comments' || chr(10) || chr(10) || 'self text' || coalesce(chr(10) || chr(10) || '---' || chr(10) || '## Comments' || chr(10) || chr(10) || said, '') AS body FROM b JOIN n USING (conv_id)),
e AS (SELECT conv_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '[ \t\r]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM t)
SELECT conv_id::VARCHAR AS thread_key, 'Topic ' || conv_id AS title, text FROM e WHERE length(text) >= 50"""


def s17_url_prompts(spark, d):
    serp = _merged(spark, d).withColumn("relevance_score", F.col("rank") / 3)
    return J.url_prompts(serp, table(spark, d, "questions"), _queries(spark, d))


S17_SQL = f"""WITH {MERGED}, {Q_SQL}, qu AS ({QUESTIONS}), l AS (SELECT research_id, query_ordinal, rank, '[' || rank - 1 || '] 標題: ' || title || chr(10) || '    URL: ' || url || chr(10) || '    摘要: ' || CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '…' ELSE coalesce(nullif(content, ''), '(無摘要)') END
 || chr(10) || '    元資料: ' || concat_ws(', ', '來源=' || nullif(engine, ''), '相關性=' || format('{{:.2f}}', rank / 3.0::DOUBLE), '日期=' || nullif(published_date, '')) AS line FROM merged),
g AS (SELECT research_id, query_ordinal, string_agg(line, chr(10) ORDER BY rank) AS body FROM l GROUP BY ALL), p AS (SELECT g.research_id, string_agg('## 第 ' || g.query_ordinal + 1 || ' 組搜尋結果（搜尋字詞：' || query || '）' || chr(10) || body || chr(10), chr(10) ORDER BY g.query_ordinal) AS parts FROM g JOIN q ON g.research_id = q.research_id AND g.query_ordinal = q.query_ordinal GROUP BY g.research_id)
SELECT p.research_id, '## 用戶原始問題' || chr(10) || question || chr(10) || chr(10) || parts AS prompt FROM p JOIN qu ON p.research_id = qu.research_id"""


def s18_chunk_prompts(spark, d):
    """The ten best chunks of each session to choose from in round 2, the two next ones as evidence of round 1."""
    chunks = K.topk_chunks(_chunks(spark, d), 12).withColumns({"round": F.lit(1), "title": F.when(F.col("source_ordinal") % 2 == 0, F.concat(F.lit("Doc "), "source_ordinal")), "source_url": F.concat(F.lit("https://d.example/"), "source_ordinal"), "from_query": F.concat(F.lit("q"), F.col("source_ordinal") % 3)})
    n = F.col("research_id")
    asked = table(spark, d, "questions").select("research_id", "question", F.array(F.lit("a"), F.lit("b")).alias("queries"), F.lit(2).alias("round"), F.lit("web").alias("search_mode"), F.lit("fast").alias("mode"), F.when(n % 2 == 0, F.array(F.lit("m1"), F.lit("m2"))).alias("missing"))
    return J.chunk_prompts(chunks.filter("pick <= 10"), asked, chunks.filter("pick > 10"))


def _sources_sql(name: str, rows: str, label: str) -> str:
    return f"""{name}_s AS (SELECT research_id, source_ordinal, count(*) AS n, '來源 L1-S' || source_ordinal || ': ' || CASE WHEN source_ordinal % 2 = 0 THEN 'Doc ' || source_ordinal ELSE '(untitled)' END || chr(10) || 'URL: https://d.example/' || source_ordinal || chr(10) || 'From query: q' || source_ordinal % 3 || chr(10)
 || string_agg({label} || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_ordinal) AS part FROM ({rows}) GROUP BY research_id, source_ordinal), {name} AS (SELECT research_id, sum(n)::BIGINT AS n, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY source_ordinal) AS parts FROM {name}_s GROUP BY research_id)"""


S18_SQL = f"""WITH {CHUNKS}, c AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY score DESC, source_ordinal, chunk_ordinal) AS pick FROM chunks), {_sources_sql("now", "SELECT * FROM c WHERE pick <= 10", "'[' || chunk_id || ']'")}, {_sources_sql("old", "SELECT * FROM c WHERE pick IN (11, 12)", "'prior chunk ' || chunk_id")}
SELECT now.research_id, now.n AS n_chunks, '## 用戶問題' || chr(10) || question || chr(10) || chr(10) || chr(10) || '## 本輪' || chr(10) || '第 2 輪，搜尋模式：web，執行模式：fast' || chr(10) || chr(10) || '## 本輪搜尋字詞' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10)
 || CASE WHEN now.research_id % 2 = 0 THEN '## 上輪指出的缺口' || chr(10) || '- m1' || chr(10) || '- m2' || chr(10) || chr(10) ELSE '' END || coalesce('## 上輪已選證據（只供 sufficiency judge，不需要重新輸出這些 ID）' || chr(10) || old.parts || chr(10) || chr(10), '')
 || '## 本輪可選 chunk（共 ' || now.n || ' 個，已放入全部 ' || now.n || ' 個有效 chunk）' || chr(10) || now.parts AS prompt FROM now JOIN q0 ON now.research_id = q0.research_id LEFT JOIN old ON old.research_id = now.research_id"""


def _replies(spark, d):
    good = F.concat(F.lit('Sure: {"selected": [{"group_index": 1, "result_indices": [2, 0, 99, -1, 1]}, {"group_index": 9, "result_indices": [0]}]} ok'))
    return table(spark, d, "questions").select("research_id", F.when(F.col("research_id") % 3 > 0, good).otherwise("no json").alias("reply"))


def f29_url_picks(spark, d):
    return J.parse_url_picks(_replies(spark, d), _merged(spark, d), 2, 2).select("research_id", "group_index", "result_index")


F29_SQL = f"""WITH {MERGED}, q AS ({QUESTIONS}), n AS (SELECT research_id, query_ordinal AS g, max(rank) AS n FROM merged GROUP BY ALL),
a AS (SELECT q.research_id, 1 AS group_index, i AS result_index, row_number() OVER (PARTITION BY q.research_id ORDER BY o) AS k FROM q JOIN n ON n.research_id = q.research_id AND g = 1, (VALUES (0, 2), (1, 0), (2, 99), (3, -1), (4, 1)) v(o, i) WHERE q.research_id % 3 > 0 AND i >= 0 AND i < n.n)
SELECT research_id, group_index, result_index FROM a WHERE k <= 2 UNION ALL SELECT m.research_id, query_ordinal, rank - 1 FROM merged m JOIN q ON m.research_id = q.research_id WHERE q.research_id % 3 = 0 AND rank <= 2"""


#: By research_id % 6: fenced, among text, with text behind that holds braces, an array, ids in prose, and a broken object.
REVIEWS = (
    ('```json\n{"chunk_ids": ["L1-S1-C001", "L1-S1-C001", 7], "verdict": "Enough", "coverage": {"missing": ["m", " "]}, "next_search_queries": ["a", "b", 3, "c", "d"]}\n```', True, "sufficient", "L1-S1-C001,7", "m", "a,b,c", "web"),
    ('Well: {"selected_ids": ["x"], "verdict": "needs more", "search_mode": "Academic"} so far.', True, "insufficient", "x", "", "", "academic"),
    ('{"chunk_ids": ["x"], "verdict": "enough"} see also {L1-S4-C004}', False, "insufficient", "L1-S4-C004", "", "", "web"),
    ('["L1-S1-C001"]', False, "insufficient", "L1-S1-C001", "", "", "web"),
    ("I pick L1-S2-C003 and L1-S2-C003.", False, "insufficient", "L1-S2-C003", "", "", "web"),
    ('{"chunk_ids": ["L2-S1-C001"], "verdict": "enough"', False, "insufficient", "L2-S1-C001", "", "", "web"),
)


def _by_id(spark, d, replies):
    return table(spark, d, "questions").select("research_id", F.element_at(F.array(*map(F.lit, replies)), (F.col("research_id") % len(replies) + 1).cast("int")).alias("reply"))


def f30_chunk_reviews(spark, d):
    r = J.parse_chunk_reviews(_by_id(spark, d, [x[0] for x in REVIEWS]))
    return r.select("research_id", "parsed", "verdict", *(F.array_join(c, ",").alias(c) for c in ("selected_chunk_ids", "missing", "next_search_queries")), "search_mode")


F30_SQL = f"SELECT research_id, parsed, verdict, selected_chunk_ids, missing, next_search_queries, search_mode FROM ({QUESTIONS}) JOIN (VALUES " + ", ".join(f"({i}, {x[1]}, '{x[2]}', '{x[3]}', '{x[4]}', '{x[5]}', '{x[6]}')" for i, x in enumerate(REVIEWS)) + ") v(k, parsed, verdict, selected_chunk_ids, missing, next_search_queries, search_mode) ON k = research_id % 6"
#: By research_id % 5; queries with Q for the question.
PLANS = (
    ('{not json} then {"strategy":"Reuse","queries":["q1"]}', "reuse", "Q", "", 0),
    ('x {"strategy": "other", "queries": ["q1", " ", "Q latest information"], "refresh_source_refs": ["a", "", "b", "c"]} y {"strategy": "reuse"}', "research", "Q", "q1|Q latest information|Q in-depth analysis", 2),
    ("none", "research", "Q", "Q|Q latest information|Q in-depth analysis", 0),
    ('{{"standalone_question": "A {b}?", "queries": ["Q in-depth analysis", "Q"]}', "research", "A {b}?", "Q in-depth analysis|Q|Q perspective 3", 0),
    ('{"strategy": "direct"', "research", "Q", "Q|Q latest information|Q in-depth analysis", 0),
)


def f31_plans(spark, d):
    p = J.parse_plans(_by_id(spark, d, [x[0] for x in PLANS]).withColumn("question", F.lit("Q")))
    return p.select("research_id", "standalone_question", "strategy", F.array_join("queries", "|").alias("queries"), F.size("refresh_refs").alias("n_refs"))


F31_SQL = f"SELECT research_id, strategy, standalone_question, queries, n_refs FROM ({QUESTIONS}) JOIN (VALUES " + ", ".join(f"({i}, '{x[1]}', '{x[2]}', '{x[3]}', {x[4]})" for i, x in enumerate(PLANS)) + ") v(k, strategy, standalone_question, queries, n_refs) ON k = research_id % 5"


def f32_coerce(spark, d):
    n = F.col("research_id") % 4
    text = F.when(n == 0, '["a", "b", "A", "c"]').when(n == 1, "- a\n2. b;c | d").when(n == 2, "a, b").otherwise(F.lit(None))
    r = J.coerce_queries(table(spark, d, "questions").select("research_id", F.lit("Q").alias("question"), text.alias("search_queries")))
    return r.select("research_id", F.array_join("queries", "|").alias("queries"))


QUERIES = {
    "x3_read_serp": (x3_read_serp, X3_SQL),
    "s1_searxng": (s1_searxng, _sql("searxng", "trim(content)", "round(position / 10.0, 6)", "published_date", 30)),
    "s2_brave": (s2_brave, _sql("brave", "concat_ws(chr(10) || chr(10), nullif(trim(content), ''), 'one', 'two')", "NULL::DOUBLE", "published_date", 20)),
    "s3_tavily": (s3_tavily, _sql("tavily", "trim(content)", "round(position / 7.0, 6)", "NULL", 20)),
    "s4_exa": (s4_exa, _sql("exa", "CASE WHEN position % 2 = 0 THEN 'h1' || chr(10) || chr(10) || 'h2' ELSE trim('text ' || title) END", "CASE WHEN position % 2 = 0 THEN round((0.25 + position / 4.0) / 2, 6) END", "NULL", 100)),
    "s5_google": (s5_google, _sql("serpapi_google", "trim(content)", "NULL::DOUBLE", "published_date", 100)),
    "s6_scholar": (s6_scholar, _sql("serpapi_google_scholar", "concat_ws(chr(10) || chr(10), 'A B - J, ' || (position + 1990), nullif(trim(content), ''), CASE WHEN position > 1 THEN 'Cited by ' || (position - 1) END)", "NULL::DOUBLE", "CAST(position + 1990 AS VARCHAR)", 20)),
    "s7_forums": (s7_forums, _sql("serpapi_google_forums", "concat_ws(chr(10) || chr(10), 'site', nullif(trim(content), ''))", "NULL::DOUBLE", "NULL", 100)),
    "s8_custom": (s8_custom, _sql("mine", "trim(content)", "position * 2.0", "NULL", 4)),
    "s12_threads": (s12_threads, S12_SQL),
    "s17_url_prompts": (s17_url_prompts, S17_SQL),
    "s18_chunk_prompts": (s18_chunk_prompts, S18_SQL),
    "f29_url_picks": (f29_url_picks, F29_SQL),
    "f30_chunk_reviews": (f30_chunk_reviews, F30_SQL),
    "f31_plans": (f31_plans, F31_SQL),
    "f32_coerce_queries": (f32_coerce, f"SELECT research_id, CASE research_id % 4 WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'a|b|c' WHEN 2 THEN 'a|b|Q' ELSE 'Q|Q overview|Q details' END AS queries FROM ({QUESTIONS})"),
}
