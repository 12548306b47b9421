"""Registered queries on conversations, kept evidence and trace events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import canonical_url
from ..operators import conversations as V
from ..operators import selection as S
from ..sources.tables import MESSAGES, SERP, SESSIONS, TRACE, sessions, shared_folder, table, trace_stream
from ..streaming import trace as R
from .pages import lines_sql
from .serp import canon

KEY = "0123456789abcdef"


BLANK = "' ' || chr(9) || chr(10) || chr(13)"


def cut_sql(t: str, most: str) -> str:
    """Head and tail of a trimmed text with a mark between them."""
    head = f"greatest(80, floor(({most}) * 0.72::DOUBLE))::BIGINT"
    tail = f"greatest(40, ({most}) - {head} - 24)"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE rtrim(substring({t}, 1, {head}), {BLANK}) || chr(10) || '…（內容已受控截短）…' || chr(10) || ltrim(substring({t}, length({t}) - {tail} + 1, {tail}), {BLANK}) END"


def est_sql(t: str) -> str:
    """Tokens of a text: one for each Han character, one for every four others begun."""
    han = f"len(regexp_extract_all({t}, '[㐀-鿿]'))"
    return f"({han} + (length({t}) - {han} + 3) // 4)"


def pack_sql(budget: int) -> str:
    """Packing of rows k (conv_id, source_rank, chunk_rank, t), folded with the tokens used so far."""
    left = f"({budget} - a.used)"
    short = cut_sql("x.t", f"greatest(240, {left} * 3)")
    fit = f"CASE WHEN x.n <= {left} THEN x.n ELSE {est_sql('(' + short + ')')} END"
    return f"""pg AS (SELECT conv_id, list({{'s': source_rank::BIGINT, 'c': chunk_rank::BIGINT, 't': t, 'n': {est_sql('t')}::BIGINT}} ORDER BY chunk_rank, source_rank) AS l FROM k GROUP BY conv_id),
pf AS (SELECT conv_id, list_transform(l, lambda x: {{'s': x.s, 'c': x.c, 't': x.t, 'n': x.n, 'used': 0::BIGINT, 'out': []::STRUCT(s BIGINT, c BIGINT, n BIGINT)[]}}) AS l FROM pg),
pr AS (SELECT conv_id, list_reduce(l, lambda a, x: CASE WHEN {left} > 0 AND x.t <> '' AND ({fit}) <= {left} THEN {{'s': x.s, 'c': x.c, 't': '', 'n': x.n, 'used': a.used + ({fit}), 'out': list_append(a.out, {{'s': x.s, 'c': x.c, 'n': ({fit})::BIGINT}})}} ELSE a END,
 {{'s': 0::BIGINT, 'c': 0::BIGINT, 't': '', 'n': 0::BIGINT, 'used': 0::BIGINT, 'out': []::STRUCT(s BIGINT, c BIGINT, n BIGINT)[]}}).out AS o FROM pf),
packed AS (SELECT conv_id, y.s AS source_rank, y.c AS chunk_rank, slot, y.n AS tokens FROM (SELECT conv_id, unnest(o) AS y, generate_subscripts(o, 1) - 1 AS slot FROM pr))"""


def f3_explicit_urls(spark, d):
    u = V.explicit_urls(table(spark, d, "messages"))
    return u.withColumn("urls", F.array_join("urls", " "))


def t4_url_overflow(spark, d):
    """Messages with none to seven URLs, one of them in two spellings: five are given, all are counted."""
    n = (F.col("turn") + F.col("conv_id")) % 8
    urls = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.concat(F.lit("(https://e.example/"), k.cast("string"), F.lit("?b=1), ")))
    text = F.when(n > 0, F.concat(F.array_join(urls, ""), F.lit("https://E.example/1?utm_source=x&b=1."))).otherwise("none")
    found = V.explicit_urls(table(spark, d, "conversations").select("conv_id", "turn", text.alias("text")))
    return found.withColumn("urls", F.array_join("urls", " "))


T4_SQL = """SELECT conv_id, turn, coalesce(array_to_string(list_transform(range(1, least(n, 5) + 1), lambda k: 'https://e.example/' || k || '?b=1'), ' '), '') AS urls, n > 5 AS overflow, n::INT AS total FROM (SELECT conv_id, turn, (turn + conv_id) % 8 AS n FROM conversations)"""


def f6_keywords(spark, d):
    return table(spark, d, "messages").select("conv_id", "turn", F.array_join(F.array_sort(V.keywords(F.col("text"))), ",").alias("words"))


def keywords_sql(t: str) -> str:
    han = f"array_to_string(regexp_extract_all({t}, '[㐀-鿿]'), '')"
    words = f"list_concat(regexp_extract_all({t}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}-]{{2,}}'), list_transform(range(1, greatest(length({han}), 1)), lambda i: substring({han}, i, 2)))"
    return f"list_distinct({words})"


F6_SQL = f"SELECT conv_id, turn, array_to_string(list_sort({keywords_sql('t')}), ',') AS words FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM ({MESSAGES}))"


def _long(spark, d):
    """Messages of ten conversations as one, so that windows are exceeded."""
    m = table(spark, d, "messages")
    return m.select(F.floor(F.col("conv_id") / 10).alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text")


def w13_history(spark, d):
    return V.history_window(_long(spark, d)).select("conv_id", "turn", "at", "role", F.when((F.col("role") == "user") | F.col("full"), F.length("content")).alias("n_chars"))


W13_SQL = f"""WITH m AS ({MESSAGES}), l AS (SELECT conv_id // 10 AS conv_id, conv_id * 1000 + turn AS turn, role, trim(text, ' ' || chr(10) || chr(9)) AS content FROM m WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
p AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM l), h AS (SELECT conv_id, role, content FROM p WHERE i <= 2),
k AS (SELECT * FROM p WHERE n <= 16 OR i <= 2 OR (i > n - 14 AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = p.conv_id AND h.role = p.role AND h.content = p.content)))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at, role, CASE WHEN role = 'user' OR sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= 2 THEN length(content) END AS n_chars FROM k"""


def w14_shrink(spark, d):
    return V.shrink_history(V.history_window(_long(spark, d)), 300).select("conv_id", "at", F.length("content").alias("n_chars"))


def f25_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cut(F.col("text"), 400).alias("text"))


F25_SQL = "SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE rtrim(substring(t, 1, 288), ws) || chr(10) || '…（內容已受控截短）…' || chr(10) || ltrim(substring(t, length(t) - 87, 88), ws) END AS text FROM (SELECT doc_id, ' ' || chr(10) || chr(9) AS ws, trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) AS t FROM documents)"


def f25_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("text"))


F25E_SQL = f"""WITH a AS (SELECT doc_id, trim(coalesce(text, ''), {BLANK}) AS t FROM documents), b AS (SELECT doc_id, t, {lines_sql('t')} AS l FROM a),
c AS (SELECT doc_id, t, list_concat(['（較早回答的受控摘錄）'], list_filter(l, lambda x: regexp_matches(x, '^(#|- |\\* |•|1\\.|2\\.|3\\.)'))[1:7], [l[1], l[-1]]) AS p FROM b),
e AS (SELECT doc_id, t, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), chr(10)) AS s FROM c) SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t ELSE {cut_sql('s', '1200')} END AS text FROM e"""


def w18_recent(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") * 1000 + F.count("*")).alias("updated_at"))
    return V.recent_conversations(c)


def _sources(spark, d):
    """Evidence sources: each conversation has the next 20 documents, their lines as chunks; five URLs stand twice."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("conv_id"), "doc_id", F.concat(F.lit("Doc "), "doc_id").alias("title"), F.concat(F.lit("https://D.example/"), F.col("doc_id") % 15, F.lit("/")).alias("url"), F.split("text", "\n").alias("lines"))
    chunk = F.transform("lines", lambda t, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("chunk_id"), t.alias("text")))
    return docs.select("conv_id", F.col("doc_id").alias("source_order"), "title", "url", chunk.alias("chunks"))


def _capsules(spark, d):
    s = _sources(spark, d)
    ev = S.ordered(F.struct("title", "url", "chunks"), ["source_order"])
    return s.groupBy("conv_id", (F.col("source_order") % 4).alias("at")).agg(ev.alias("evidence")).withColumns({"turn_id": F.concat(F.lit("t"), "at"), "standalone_question": F.concat(F.lit("question "), "conv_id"), "queries": F.array(F.lit("a"), F.lit(" "), F.lit("b"))})


def g18_clean_evidence(spark, d):
    c = _capsules(spark, d).withColumn("e", F.explode(V.clean_evidence(F.col("evidence"), F.col("turn_id"))))
    return c.select("conv_id", "at", "e.title", "e.url", F.size("e.chunks").alias("n_chunks"), F.element_at("e.chunks", 1)["chunk_id"].alias("first_id"))


G18_SQL = r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, trim(unnest(string_split(text, chr(10)))) AS t FROM documents), k AS (SELECT * FROM l WHERE t <> '')
SELECT doc_id // 20 AS conv_id, doc_id % 4 AS at, 'Doc ' || doc_id AS title, 'https://D.example/' || doc_id % 15 || '/' AS url, count(*) AS n_chunks, 't' || doc_id % 4 || ':C' || min(i) AS first_id FROM k GROUP BY doc_id"""


def s15_s16_capsules(spark, d):
    sealed = V.seal_capsules(_capsules(spark, d).withColumn("turn_id", F.concat_ws("-", "conv_id", "turn_id")), KEY)
    at = F.regexp_extract("turn_id", "t([0-9]+)$", 1).cast("long")
    tokens = sealed.select(F.split("turn_id", "-")[0].cast("long").alias("conv_id"), at.alias("at"), F.when(at == 3, F.concat(F.lit("x"), "token")).otherwise(F.col("token")).alias("token"))
    return V.unseal_capsules(tokens, KEY).select("conv_id", "at", "turn_id", F.size("evidence").alias("n_sources"), F.size("queries").alias("n_queries"), F.aggregate("evidence", F.lit(0), lambda a, s: a + F.size(s["chunks"])).alias("n_chunks"))


S15_SQL = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents),
k AS (SELECT (doc_id // 20) * 4 + doc_id % 4 AS conv_id, doc_id AS source_rank, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_rank, trim(raw, {BLANK}) AS t FROM l WHERE trim(raw, ' ') <> ''), {pack_sql(12000)}
SELECT conv_id // 4 AS conv_id, conv_id % 4 AS at, conv_id // 4 || '-t' || conv_id % 4 AS turn_id, count(DISTINCT source_rank)::INT AS n_sources, 2 AS n_queries, count(*)::INT AS n_chunks FROM packed WHERE conv_id % 4 < 3 GROUP BY conv_id"""


def g12_ledger(spark, d):
    l = V.research_ledger(_capsules(spark, d))
    return l.select("conv_id", "at", "question", F.array_join(F.transform("sources", lambda s: s["source_ref"]), ",").alias("refs"), "selected_chunk_count")


G12_SQL = """WITH s AS (SELECT doc_id // 20 AS conv_id, doc_id % 4 AS pos, row_number() OVER (PARTITION BY doc_id // 20, doc_id % 4 ORDER BY doc_id) AS i, len(string_split(text, chr(10))) AS n FROM documents)
SELECT conv_id, pos AS at, 'question ' || conv_id AS question, string_agg('t' || pos || ':S' || i, ',' ORDER BY i) FILTER (i <= 10) AS refs, sum(n)::BIGINT AS selected_chunk_count FROM s GROUP BY conv_id, pos"""


def _ledger_rows(spark, d):
    l = V.research_ledger(_capsules(spark, d))
    return l.select("conv_id", F.explode("sources").alias("s")).select("conv_id", "s.*")


def j8_refreshable(spark, d):
    refs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("conv_id")).distinct().withColumn("r", F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(x).alias("source_ref")) for i, x in enumerate(("t1:S2", "t0:S1", "t9:S1", "t2:S1", "t1:S1"))))))
    return V.refreshable_sources(_ledger_rows(spark, d), refs.select("conv_id", "r.*")).select("conv_id", "source_ref", "url")


J8_SQL = """WITH s AS (SELECT doc_id // 20 AS conv_id, 't' || doc_id % 4 || ':S' || row_number() OVER (PARTITION BY doc_id // 20, doc_id % 4 ORDER BY doc_id) AS source_ref, 'https://D.example/' || doc_id % 15 || '/' AS url FROM documents),
f AS (SELECT s.*, ordinal FROM s JOIN (VALUES (0, 't1:S2'), (1, 't0:S1'), (2, 't9:S1'), (3, 't2:S1'), (4, 't1:S1')) r(ordinal, ref) ON source_ref = ref), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, url ORDER BY ordinal) = 1)
SELECT conv_id, source_ref, url FROM o QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ordinal) <= 2"""


def j9_exclude_sources(spark, d):
    s = _sources(spark, d)
    again = s.filter("source_order % 7 = 0").select("conv_id", F.lower("url").alias("url"))
    return V.exclude_sources(s, again).select("conv_id", "source_order")


J9_SQL = "WITH s AS (SELECT doc_id // 20 AS conv_id, doc_id AS source_order, doc_id % 15 AS k FROM documents) SELECT conv_id, source_order FROM s WHERE NOT EXISTS (SELECT 1 FROM s r WHERE r.source_order % 7 = 0 AND r.conv_id = s.conv_id AND r.k = s.k)"


def j11_merge_refreshed(spark, d):
    """Pages of the round and pages read again, of which some fail; what has failed, before and now, has no place in the order."""
    p = table(spark, d, "pages").select((F.col("page_id") % sessions(spark, d)).alias("research_id"), "url", F.col("page_id").alias("page_order"), (F.col("page_id") % 5 > 0).alias("success"))
    old, new = p.filter("page_order % 3 > 0"), p.filter("page_order % 2 = 0 or page_order % 3 = 0")
    failed = V.refresh_failures(old.filter("not success").select("research_id", "url", F.lit("q").alias("from_query")), new)
    merged = V.merge_refreshed(old.filter("success").drop("success"), new).withColumn("from_query", F.lit(None).cast("string"))
    return merged.unionByName(failed.withColumn("page_order", F.lit(None).cast("int")))


J11_SQL = f"""WITH p AS (SELECT page_id % {SESSIONS} AS research_id, url, page_id AS o, {canon('url')} AS k FROM pages), a AS (SELECT * FROM p WHERE o % 3 > 0 AND o % 5 > 0), n AS (SELECT * FROM p WHERE o % 2 = 0 OR o % 3 = 0),
b AS (SELECT * FROM n WHERE o % 5 > 0 AND NOT EXISTS (SELECT 1 FROM a WHERE a.research_id = n.research_id AND a.k = n.k) QUALIFY row_number() OVER (PARTITION BY research_id, k ORDER BY o) = 1),
u AS (SELECT *, 0 AS n FROM b UNION ALL SELECT *, 1 FROM a) SELECT research_id, url, row_number() OVER (PARTITION BY research_id ORDER BY n, o)::INT AS page_order, NULL::VARCHAR AS from_query FROM u
UNION ALL SELECT research_id, url, NULL, 'q' FROM p WHERE o % 3 > 0 AND o % 5 = 0 UNION ALL SELECT research_id, url, NULL, 'Refreshed verified source' FROM n WHERE o % 5 = 0"""


def g17_merge_evidence(spark, d):
    s = _sources(spark, d)
    m = V.merge_evidence(s.filter("source_order % 2 = 0"), s.filter("source_order % 2 = 1"))
    return m.select("conv_id", "source_index", "title", "citation_marker", F.size("chunks").alias("n_chunks"))


G17_SQL = """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS t FROM documents), s AS (SELECT doc_id // 20 AS c, doc_id % 15 AS k, min((doc_id % 2, doc_id)) AS f FROM documents GROUP BY ALL),
n AS (SELECT doc_id // 20 AS c, doc_id % 15 AS k, count(DISTINCT (i, t)) AS n_chunks FROM l GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f) AS source_index FROM s)
SELECT o.c AS conv_id, source_index, 'Doc ' || f[2] AS title, '[citation](' || source_index || '://D.example/' || o.k || '/)' AS citation_marker, n_chunks FROM o JOIN n ON o.c = n.c AND o.k = n.k"""


def w11_pack(spark, d):
    s = _sources(spark, d).select("conv_id", F.col("source_order").alias("source_rank"), F.posexplode("chunks").alias("chunk_rank", "c")).select("conv_id", "source_rank", "chunk_rank", "c.chunk_id", "c.text")
    return V.pack_tokens(s, ["conv_id"], 2000).select("conv_id", "source_rank", "chunk_rank", "slot", "tokens")


LINES_SQL = f"SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_rank, trim(unnest(string_split(text, chr(10))), {BLANK}) AS t FROM documents"
W11_SQL = f"WITH k AS (SELECT doc_id // 20 AS conv_id, doc_id AS source_rank, chunk_rank, t FROM ({LINES_SQL})), {pack_sql(2000)} SELECT * FROM packed"
W12_SQL = f"""WITH s AS (SELECT doc_id // 20 AS conv_id, doc_id, doc_id % 4 AS recency, doc_id % 15 AS u, 'doc ' || doc_id || chr(10) || lower(text) AS body FROM documents), q AS (SELECT item_id AS conv_id, {keywords_sql("lower(coalesce(text, ''))")} AS w FROM benchmark),
m AS (SELECT s.*, len(list_filter(w, lambda x: contains(body, x))) AS score FROM s JOIN q ON s.conv_id = q.conv_id QUALIFY row_number() OVER (PARTITION BY s.conv_id, u ORDER BY score DESC, recency, doc_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, recency, doc_id) AS source_rank FROM m), k AS (SELECT conv_id, source_rank, chunk_rank, t FROM r JOIN ({LINES_SQL}) USING (doc_id)), {pack_sql(800)}
SELECT packed.conv_id, packed.source_rank, chunk_rank, score, tokens FROM packed JOIN r ON packed.conv_id = r.conv_id AND packed.source_rank = r.source_rank"""


def w12_relevant(spark, d):
    s = _sources(spark, d).withColumn("recency", F.col("source_order") % 4)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), F.col("text").alias("question"))
    return V.relevant_prior(s, q, 800).select("conv_id", "source_rank", "chunk_rank", "score", "tokens")


def r2_trace_state(spark, d):
    return R.trace_state(table(spark, d, "trace"))


#: Events with what they name (item), the preview of their chunk, and the stage that they set.
TRACED = f"""e0 AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM ({TRACE})), e1 AS (SELECT *, nullif(CASE WHEN length(squeezed) > 280 THEN rtrim(substring(squeezed, 1, 277)) || '…' ELSE squeezed END, '') AS preview FROM e0),
e AS (SELECT * EXCLUDE (stage), CASE WHEN type IN ('final_evidence', 'direct_evidence') THEN coalesce(nullif(chunk_id, ''), url || ':' || preview) ELSE coalesce(nullif(url, ''), nullif(title, '')) END AS item,
 coalesce(nullif(stage, ''), CASE type WHEN 'plan' THEN 'searching' WHEN 'search_results' THEN 'url_judge' WHEN 'url_selection' THEN 'crawling' WHEN 'final_evidence' THEN 'evidence' WHEN 'direct_sources' THEN 'direct_crawl' WHEN 'refresh_sources' THEN 'direct_crawl' WHEN 'direct_evidence' THEN 'chunk_judge' END) AS st FROM e1)"""
R2_SQL = f"""WITH {TRACED}
SELECT turn_id, coalesce(arg_max(st, seq) FILTER (st IS NOT NULL), 'planning') AS stage, count(*) AS n_events, count(DISTINCT nullif(query, '')) FILTER (type IN ('plan', 'search_results', 'url_selection', 'final_evidence')) AS n_queries,
 count(DISTINCT (query, item)) FILTER (type = 'search_results' AND query <> '' AND item IS NOT NULL) AS n_sources, count(DISTINCT (query, item)) FILTER (type = 'url_selection' AND query <> '' AND item IS NOT NULL) AS n_selected, count(DISTINCT (query, item)) FILTER (type = 'final_evidence' AND query <> '' AND item IS NOT NULL) AS n_chunks,
 count(DISTINCT item) FILTER (type IN ('direct_sources', 'refresh_sources')) AS n_direct_sources, count(DISTINCT item) FILTER (type = 'direct_evidence') AS n_direct_chunks FROM e GROUP BY turn_id"""


def r1_trace_stream(spark, d):
    return R.run_trace_stream(trace_stream(spark, d), shared_folder(spark, "trace"))


def r2_trace_items(spark, d):
    return R.trace_items(table(spark, d, "trace"))


R2I_SQL = f"WITH {TRACED} SELECT turn_id, query, CASE type WHEN 'search_results' THEN 'sources' WHEN 'url_selection' THEN 'selected_sources' ELSE 'final_chunks' END AS field, item, min(seq) AS first_seq FROM e WHERE type IN ('search_results', 'url_selection', 'final_evidence') AND query <> '' AND item IS NOT NULL GROUP BY ALL"


def r3_trace_events(spark, d):
    return R.trace_events(table(spark, d, "trace"))


R3_SQL = f"""WITH {TRACED}, f AS (SELECT *, type IN ('final_evidence', 'direct_evidence') AS chunk, type IN ('search_results', 'url_selection', 'direct_sources', 'refresh_sources') AS source FROM e)
SELECT turn_id, seq, row_number() OVER (PARTITION BY turn_id ORDER BY seq) AS at, type, CASE WHEN type IN ('plan', 'search_results', 'url_selection', 'final_evidence') THEN nullif(query, '') END AS query,
 CASE WHEN source THEN coalesce(nullif(title, ''), nullif(url, ''), 'Untitled') WHEN chunk THEN title END AS title, CASE WHEN source OR chunk THEN url END AS url, CASE WHEN chunk THEN chunk_id END AS chunk_id, CASE WHEN chunk THEN coalesce(preview, '') END AS preview
FROM f WHERE NOT chunk OR chunk_id <> '' OR preview IS NOT NULL"""


def r4_result_ingest(spark, d):
    """Result rows that come in four parts, the general lane before the academic one, which repeats its pages under other URLs a day later; the ingest ends after each part and begins again where it was."""
    folder = shared_folder(spark, "ingest")
    rows = table(spark, d, "serp").select("research_id", "query_ordinal", "url", "source_ordinal", "page_id", F.timestamp_seconds(F.col("page_id") * 60 + F.col("source_ordinal") * 86_400).alias("ingest_time"))
    found = None
    for lane, half in ((0, 0), (0, 1), (1, 0), (1, 1)):
        rows.filter((F.col("source_ordinal") == lane) & (F.pmod(F.floor(F.col("page_id") / 2), F.lit(2)) == half)).write.mode("append").parquet(f"{folder}/in")
        found = R.ingest_results(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)
    return found.select("research_id", "query_ordinal", "url_key")


R4_SQL = f"SELECT DISTINCT research_id, query_ordinal, {canon('url')} AS url_key FROM ({SERP})"


QUERIES = {
    "f3_explicit_urls": (f3_explicit_urls, f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'https://example.com/a?x=' || conv_id ELSE '' END AS urls, FALSE AS overflow, (turn % 3 = 0)::INT AS total FROM ({MESSAGES})"),
    "t4_url_overflow": (t4_url_overflow, T4_SQL),
    "f6_keywords": (f6_keywords, F6_SQL),
    "w13_history_window": (w13_history, W13_SQL),
    "w14_shrink_history": (w14_shrink, None),
    "f25_cut": (f25_cut, F25_SQL),
    "f25_excerpt": (f25_excerpt, F25E_SQL),
    "w18_recent": (w18_recent, "SELECT conv_id, max(turn) * 1000 + count(*) AS updated_at FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id LIMIT 24"),
    "g18_clean_evidence": (g18_clean_evidence, G18_SQL),
    "s15_s16_capsules": (s15_s16_capsules, S15_SQL),
    "g12_research_ledger": (g12_ledger, G12_SQL),
    "j8_refreshable": (j8_refreshable, J8_SQL),
    "j9_exclude_sources": (j9_exclude_sources, J9_SQL),
    "j11_merge_refreshed": (j11_merge_refreshed, J11_SQL),
    "g17_merge_evidence": (g17_merge_evidence, G17_SQL),
    "w11_pack_tokens": (w11_pack, W11_SQL),
    "w12_relevant_prior": (w12_relevant, W12_SQL),
    "r2_trace_state": (r2_trace_state, R2_SQL),
    "r1_trace_stream": (r1_trace_stream, R2_SQL),
    "r2_trace_items": (r2_trace_items, R2I_SQL),
    "r3_trace_events": (r3_trace_events, R3_SQL),
    "r4_result_ingest": (r4_result_ingest, R4_SQL),
}
