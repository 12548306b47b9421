"""Registered queries on chunks, evidence, PDF pages and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..operators import chunks as K
from ..operators import reports as R
from ..operators import selection as S
from ..sources.tables import CRAWL_LOG, QUESTIONS, SERP, SESSIONS, sessions, table
from .pages import F19_SQL
from .serp import canon

WS = "' ' || chr(9) || chr(10) || chr(13)"
PARAS = f"""l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
l1 AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), {WS}) AS t FROM l0), l2 AS (SELECT * FROM l1 WHERE length(t) >= 80),
l3 AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY doc_id, replace(lower(substring(t, 1, 220)), 'ß', 'ss') ORDER BY i) = 1),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, t AS text FROM l3)"""
TERMS = f"""q0 AS ({QUESTIONS}), terms AS (SELECT research_id, question, list_filter(x, lambda w, i: list_position(x, w) = i)[1:24] AS terms FROM (SELECT research_id, question, regexp_extract_all(lower(question), '[A-Za-z0-9_+-]{{3,}}|[一-鿿]{{2,}}') AS x FROM q0))"""
CHUNKS = f"""{PARAS}, {TERMS}, chunks AS (SELECT doc_id % {SESSIONS} AS research_id, doc_id AS source_ordinal, k AS chunk_ordinal, format('L1-S{{}}-C{{:03d}}', greatest(doc_id, 1), k) AS chunk_id, text,
 round(CASE k WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.0 END + 1.25 * len(list_filter(terms, lambda w: contains(lower(text), w))) + least(length(text), 900) / 900.0::DOUBLE, 9) AS score FROM paras JOIN terms ON doc_id % {SESSIONS} = research_id)"""


def _paras(spark, d):
    p = K.dedupe_paragraphs(K.paragraphs(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(p).alias("at", "text"))


def _chunks(spark, d):
    terms = table(spark, d, "questions").select("research_id", T.review_terms(F.col("question")).alias("terms"))
    rows = _paras(spark, d).withColumn("research_id", F.col("doc_id") % sessions(spark, d)).join(terms, "research_id")
    return rows.select("research_id", F.col("doc_id").alias("source_ordinal"), (F.col("at") + 1).alias("chunk_ordinal"), F.concat(F.lit("L1-S"), "doc_id").alias("source_ref"), T.chunk_id(F.lit(1), F.col("doc_id"), F.col("at") + 1).alias("chunk_id"), "text", F.round(T.chunk_score(F.col("text"), F.col("at"), F.col("terms")), 9).alias("score"))


SHORT = ("research_id", "chunk_id", "source_ordinal", "pick")


def f4_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


def f5_terms(spark, d):
    return table(spark, d, "questions").select("research_id", F.array_join(T.review_terms(F.col("question")), ",").alias("terms"))


def f8_w15_paragraphs(spark, d):
    return _paras(spark, d).select("doc_id", (F.col("at") + 1).alias("k"), "text")


def f7_j6_f28_chunks(spark, d):
    return _chunks(spark, d).drop("source_ref")


def w10_fallback(spark, d):
    return K.fallback_chunks(_chunks(spark, d)).select(*SHORT)


W10_SQL = f"WITH {CHUNKS}, h AS (SELECT *, row_number() OVER (PARTITION BY research_id, source_ordinal ORDER BY chunk_ordinal) = 1 AS head FROM chunks) SELECT research_id, chunk_id, source_ordinal, row_number() OVER (PARTITION BY research_id ORDER BY head DESC, CASE WHEN head THEN 0 ELSE -score END, source_ordinal, chunk_ordinal) AS pick FROM h QUALIFY pick <= 12"


def t3_topk(spark, d):
    return K.topk_chunks(_chunks(spark, d), 5).select(*SHORT)


T3_SQL = f"WITH {CHUNKS} SELECT research_id, chunk_id, source_ordinal, row_number() OVER (PARTITION BY research_id ORDER BY score DESC, source_ordinal, chunk_ordinal) AS pick FROM chunks QUALIFY pick <= 5"


def j7_valid_ids(spark, d):
    n = sessions(spark, d)
    ids = F.array(*(F.format_string("L1-S%d-C%03d", (F.col("research_id") + n * (k % 3)).cast("long"), F.lit(k % 4)) for k in (1, 2, 3, 5, 1, 9)))
    reviews = table(spark, d, "questions").select("research_id", ids.alias("selected_chunk_ids"))
    return K.valid_selected_ids(reviews, _chunks(spark, d))


J7_SQL = f"WITH {CHUNKS}, n AS (SELECT research_id, format('L1-S{{}}-C{{:03d}}', research_id + {SESSIONS} * (k % 3), k % 4) AS chunk_id, pos FROM q0, (VALUES (1, 0), (2, 1), (3, 2), (5, 3), (1, 4), (9, 5)) v(k, pos)), f AS (SELECT research_id, chunk_id, min(pos) AS pos FROM n SEMI JOIN chunks USING (research_id, chunk_id) GROUP BY ALL) SELECT research_id, chunk_id, row_number() OVER (PARTITION BY research_id ORDER BY pos) AS pick FROM f"


def _evidence(spark, d):
    picked = K.topk_chunks(_chunks(spark, d), 40)
    pages = table(spark, d, "pages").select((F.col("page_id") % sessions(spark, d)).alias("research_id"), F.col("page_id").alias("page_order"), F.col("page_id"), "url", T.extract_title(F.col("html")).alias("title"))
    # a document stands for the page of its number, round and round the page table
    chunks = picked.join(pages.select("page_id", F.col("url").alias("source_url")), F.col("source_ordinal") % max(1, pages.count()) == F.col("page_id"))
    return K.evidence_join(pages.drop("page_id"), chunks.drop("page_id"))


def j4_f27_evidence(spark, d):
    return _evidence(spark, d).select("research_id", "source_index", "chunk_id", "citation_marker", "url")


CITED = f"""{CHUNKS}, c AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY score DESC, source_ordinal, chunk_ordinal) AS pick FROM chunks QUALIFY pick <= 40),
pg AS (SELECT page_id, page_id % {SESSIONS} AS research_id, url, {canon('url')} AS url_key FROM pages), k AS (SELECT c.research_id, c.chunk_id, c.pick, c.text, pg.url_key FROM c JOIN pg ON c.source_ordinal % (SELECT count(*) FROM pages) = pg.page_id),
u AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY research_id, url_key ORDER BY page_id) = 1), v AS (SELECT * FROM u SEMI JOIN k ON u.research_id = k.research_id AND u.url_key = k.url_key), n AS (SELECT *, row_number() OVER (PARTITION BY research_id ORDER BY page_id) AS source_index FROM v),
cited AS (SELECT k.research_id, source_index, chunk_id, pick, text, regexp_replace(n.url_key, '^https?:', '') AS citation_id, '[citation](' || source_index || ':' || regexp_replace(n.url_key, '^https?:', '') || ')' AS citation_marker, n.url, n.page_id FROM k JOIN n ON k.research_id = n.research_id AND k.url_key = n.url_key)"""
J4_SQL = f"WITH {CITED} SELECT research_id, source_index, chunk_id, citation_marker, url FROM cited"
P23_SQL = f"WITH {CITED} SELECT research_id, source_index, length(string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY pick)) AS content_length FROM cited GROUP BY ALL"
S13_SQL = f"""WITH {CITED}, ti AS ({F19_SQL}), o AS (SELECT research_id, source_index, cited.page_id, url, citation_id, citation_marker, list({{'chunk_id': chunk_id, 'text': text}} ORDER BY pick) AS chunks FROM cited GROUP BY ALL)
SELECT research_id, to_json(list({{'source_index': source_index, 'title': title, 'url': url, 'citation_id': citation_id, 'citation_marker': citation_marker, 'chunks': chunks}} ORDER BY source_index))::VARCHAR AS evidence FROM o JOIN ti ON o.page_id = ti.page_id GROUP BY research_id"""


def p23_s13_bundle(spark, d):
    return K.evidence_bundle(_evidence(spark, d)).select("research_id", F.to_json("evidence").alias("evidence"))


def p23_evidence_pages(spark, d):
    return K.evidence_pages(_evidence(spark, d)).select("research_id", "source_index", "content_length")


def u3_all_evidence(spark, d):
    c = _chunks(spark, d)
    rounds = [K.topk_chunks(c.filter(F.col("source_ordinal") % 3 != k), 6).withColumn("round", F.lit(k)) for k in range(3)]
    both = rounds[0].unionByName(rounds[1]).unionByName(rounds[2])
    return S.first_by(both, ["research_id", "chunk_id", "source_ordinal"], ["round", "pick"]).select(*SHORT, "round")


U3_SQL = f"WITH {CHUNKS}, r AS (SELECT c.*, k AS round, row_number() OVER (PARTITION BY research_id, k ORDER BY score DESC, source_ordinal, chunk_ordinal) AS pick FROM chunks c, (VALUES (0), (1), (2)) v(k) WHERE source_ordinal % 3 <> k QUALIFY pick <= 6) SELECT research_id, chunk_id, source_ordinal, pick, round FROM r QUALIFY row_number() OVER (PARTITION BY research_id, chunk_id, source_ordinal ORDER BY round, pick) = 1"


def _chunked(spark, d):
    q = table(spark, d, "questions")
    docs = table(spark, d, "documents").select((F.col("doc_id") % sessions(spark, d)).alias("research_id"), F.col("doc_id").alias("source_ordinal"), F.concat(F.lit("https://d.example/"), "doc_id").alias("url"), F.lit("").alias("title"), F.lit("").alias("from_query"), F.lit("html").alias("resource_type"), "text")
    return docs.join(q, "research_id")


def c4_f9_chunk_pages(spark, d):
    return K.chunk_pages(_chunked(spark, d)).select("source_ordinal", "chunk_id", "text", F.round("score", 6).alias("score"))


#: Pieces of a long paragraph by sentences, folded into parts of up to 1400 characters; slices where there is one sentence.
C4_SQL = rf"""WITH {PARAS}, {TERMS}, w AS (SELECT doc_id, k, text, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS pieces FROM paras),
f AS (SELECT *, list_reduce(list_transform(pieces, lambda x: {{'t': x, 'out': []::VARCHAR[]}}), lambda a, x: CASE WHEN length(a.t) + 1 + length(x.t) <= 1400 THEN {{'t': a.t || ' ' || x.t, 'out': a.out}} ELSE {{'t': x.t, 'out': list_append(a.out, a.t)}} END) AS z FROM w WHERE length(text) > 1400 AND len(pieces) > 1),
v AS (SELECT doc_id, k, list_append(z.out, z.t) AS parts FROM f UNION ALL SELECT doc_id, k, [text] FROM w WHERE length(text) <= 1400
 UNION ALL SELECT doc_id, k, list_transform(range((length(text) - 1) // 1400 + 1), lambda i: trim(substring(text, i * 1400 + 1, 1400), ' ')) FROM w WHERE length(text) > 1400 AND len(pieces) <= 1),
u AS (SELECT doc_id, k, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM v), o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS n FROM u)
SELECT doc_id AS source_ordinal, format('L1-S{{}}-C{{:03d}}', greatest(doc_id, 1), n) AS chunk_id, text, round(CASE n WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.0 END + 1.25 * len(list_filter(terms, lambda w: contains(lower(text), w))) + least(length(text), 900) / 900.0::DOUBLE, 6) AS score FROM o JOIN terms ON doc_id % {SESSIONS} = research_id"""


def f8_pdf_chunks(spark, d):
    return K.chunk_pages(_chunked(spark, d).withColumn("resource_type", F.lit("pdf"))).select("source_ordinal", "chunk_id", F.length("text").alias("n_chars"))


def g19_retention(spark, d):
    pages = _chunked(spark, d)
    return K.chunk_retention(pages, _paras(spark, d).select((F.col("doc_id") % sessions(spark, d)).alias("research_id"), F.col("doc_id").alias("source_ordinal"), "text")).withColumn("retention", F.round("retention", 6))


G19_SQL = f"""WITH {CHUNKS}, g AS (SELECT research_id, source_ordinal, sum(length(text))::BIGINT AS c, count(*) AS n FROM chunks GROUP BY ALL), b AS (SELECT doc_id % {SESSIONS} AS research_id, doc_id AS source_ordinal, length(text) AS extracted_chars,
 list_sort(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> ''), lambda x: length(x))) AS s FROM documents WHERE doc_id % {SESSIONS} IN (SELECT research_id FROM q0))
SELECT b.research_id, b.source_ordinal, extracted_chars, coalesce(c, 0) AS chunk_chars, coalesce(n, 0) AS n_chunks, s[(len(s) + 1) // 2] AS median_line, round(coalesce(c, 0) / greatest(extracted_chars, 1)::DOUBLE, 6) AS retention, coalesce(c, 0) / greatest(extracted_chars, 1)::DOUBLE >= 0.2 AS passes FROM b LEFT JOIN g ON b.research_id = g.research_id AND b.source_ordinal = g.source_ordinal"""


def _pdf(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    n = F.col("at") + 1
    return lines.select("doc", n.alias("page_no"), "text", (n % 2).alias("image_count"), (n % 3 > 0).alias("has_text_blocks"))


PDF = "pdf AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS page_no, unnest(string_split(text, chr(10))) AS text FROM documents), st AS (SELECT doc, page_no, page_no % 2 AS image_count, length(trim(text, " + WS + ")) AS char_count, len(regexp_extract_all(text, '\\S+')) AS word_count, round(length(regexp_replace(text, '\\s', '', 'g')) / greatest(length(trim(text, " + WS + ")), 1)::DOUBLE, 3) AS printable_ratio, page_no % 3 > 0 AS has_text_blocks FROM pdf)"


def s11_pdf_text(spark, d):
    return R.assemble_pdf_text(_pdf(spark, d))


S11_SQL = f"WITH {PDF}, c AS (SELECT doc, page_no, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), {WS}) AS t FROM pdf), n AS (SELECT doc, count(*) AS n_pages FROM c GROUP BY doc) SELECT n.doc, n_pages, coalesce(string_agg(CASE WHEN n_pages > 1 THEN '## 第 ' || page_no || ' 頁' || chr(10) || chr(10) || t ELSE t END, chr(10) || chr(10) ORDER BY page_no) FILTER (t <> ''), '') AS text FROM n JOIN c ON n.doc = c.doc GROUP BY n.doc, n_pages"


def g11_pdf_stats(spark, d):
    return R.pdf_page_stats(_pdf(spark, d)).select("doc", "page_no", "char_count", "word_count", "printable_ratio", "needs_ocr")


def g10_pdf_mode(spark, d):
    return R.pdf_document_mode(R.pdf_page_stats(_pdf(spark, d)))


def _rounds(spark, d):
    log = table(spark, d, "crawl_log").withColumn("round", F.col("page_id") % 3 + 1)
    per = log.groupBy("research_id", "round").agg(F.count("*").alias("total"), F.count_if("success").alias("selected"), F.count_if(F.col("page_id") % 2 == 0).alias("prompted"))
    return per.withColumn("verdict", F.when((F.col("research_id") + F.col("round")) % 2 == 0, "sufficient").otherwise("insufficient"))


ROUNDS = f"r AS (SELECT research_id, page_id % 3 + 1 AS round, count(*) AS total, count(*) FILTER (success) AS selected, count(*) FILTER (page_id % 2 = 0) AS prompted, CASE WHEN (research_id + page_id % 3 + 1) % 2 = 0 THEN 'sufficient' ELSE 'insufficient' END AS verdict FROM ({CRAWL_LOG}) GROUP BY ALL)"


def g5_run_summary(spark, d):
    return R.run_summary(_rounds(spark, d), ["total", "selected", "prompted"])


def g6_chunk_summary(spark, d):
    return R.chunk_filter_summary(_rounds(spark, d)).withColumn("rounds", F.array_join(F.transform("rounds", lambda r: F.concat_ws(":", r["round"], r["prompted"], r["selected"])), "|"))


def g4_merge_attempts(spark, d):
    a = _rounds(spark, d).select("research_id", F.col("round").alias("attempt"), "total", "selected", F.array(F.col("verdict")).alias("errors"), (F.col("verdict") == "sufficient").alias("success"), F.concat(F.lit("E"), (F.col("round") % 2).cast("string")).alias("error"), F.filter(F.array(F.struct(F.concat(F.lit("p"), "round").alias("url"))), lambda _: F.col("selected") > 2).alias("pages"))
    merged = R.merge_attempts(a, ["total", "selected"], ["errors"], "pages")
    return merged.withColumns({"errors": F.array_join("errors", ","), "pages": F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["url"], p["from_social_fallback"].cast("string"))), ",")})


def p19_completion(spark, d):
    s = R.run_summary(_rounds(spark, d), ["selected"])
    return R.completion_state(s.select("research_id", (F.col("selected") - 9).alias("evidence"), F.col("last_verdict").alias("verdict")))


def g9_group_sources(spark, d):
    rows = table(spark, d, "serp").select("research_id", F.when(F.col("query_ordinal") > 0, F.concat(F.lit("q"), "query_ordinal")).alias("query"), "title", "url", (F.col("source_ordinal") * 1000 + F.col("position")).alias("ordinal"))
    g = R.group_sources(rows)
    return g.select("research_id", "query", "first", F.array_join(F.transform("sources", lambda s: s["url"]), " ").alias("urls"))


def g15_content_map(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % sessions(spark, d)).alias("research_id"), (F.col("page_id") % 3 + 1).alias("round"), F.col("page_id").alias("source_ordinal"), "url", F.lit("t").alias("title"))
    n = F.col("research_id")
    rounds = table(spark, d, "questions").select("research_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("round"), F.when(n % 2 == 0, "academic").alias("search_mode"), F.when(n % 3 > 0, F.array(F.lit("a"), F.col("question"))).alias("queries"), F.when(n % 5 > 0, "gap").alias("reason"))
    guide = F.array_join(F.transform("page_guide", lambda g: F.concat_ws(":", g["index"].cast("string"), g["url"])), " ")
    return R.content_map(p, rounds).select("research_id", "round", "search_mode", F.array_join("queries", "|").alias("queries"), "triggered_by", "page_count", guide.alias("guide"))


def _requests(spark, d):
    n = F.col("research_id")
    return table(spark, d, "questions").select(n, F.when(n % 7 == 0, " ").otherwise(F.col("question")).alias("question"), F.when(n % 5 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.when(n % 3 == 1, "").otherwise("c"))).alias("queries"), (n % 4).alias("min_total"), F.lit(2).alias("max_total"), F.when(n % 2 == 0, " Academic").otherwise("x").alias("search_mode"), F.when(n % 3 == 0, "FULL").alias("mode"))


def p20_normalize(spark, d):
    return R.normalize_request(_requests(spark, d)).select("research_id", "search_mode", "mode")


def p21_validate(spark, d):
    return R.validate_requests(_requests(spark, d), 3).select("research_id", "error")


def p18_route(spark, d):
    n = F.col("research_id")
    t = table(spark, d, "questions").select(n, (n % 6 == 5).alias("force_research"), F.when(n % 3 == 0, "reuse").when(n % 3 == 1, "direct").otherwise("research").alias("strategy"), (n % 2).alias("pages_read"), F.when(n % 4 < 2, "sufficient").otherwise("insufficient").alias("verdict"), (n % 5).alias("prior_evidence"), F.lit(0).alias("explicit_urls"), (n % 4).alias("direct_evidence"), F.lit(0).alias("refresh_urls"))
    return R.route_turns(t).select("research_id", "route")


def s14_payload(spark, d):
    s = R.run_summary(_rounds(spark, d), ["total", "selected"])
    return R.public_payload(s.withColumn("secret", F.lit("x")), {"total": 0, "selected": 0, "last_verdict": "", "note": "none"})


QUERIES = {
    "f4_est_tokens": (f4_tokens, "SELECT doc_id, CAST(floor((length(coalesce(text, '')) + 3) / 4) AS BIGINT) AS tokens FROM documents"),
    "f5_review_terms": (f5_terms, f"WITH {TERMS} SELECT research_id, array_to_string(terms, ',') AS terms FROM terms"),
    "f8_w15_paragraphs": (f8_w15_paragraphs, f"WITH {PARAS} SELECT * FROM paras"),
    "f7_j6_f28_chunks": (f7_j6_f28_chunks, f"WITH {CHUNKS} SELECT * FROM chunks"),
    "w10_fallback_chunks": (w10_fallback, W10_SQL),
    "t3_topk_chunks": (t3_topk, T3_SQL),
    "j7_valid_ids": (j7_valid_ids, J7_SQL),
    "j4_f27_evidence": (j4_f27_evidence, J4_SQL),
    "s13_evidence_bundle": (p23_s13_bundle, S13_SQL),
    "p23_evidence_pages": (p23_evidence_pages, P23_SQL),
    "u3_all_evidence": (u3_all_evidence, U3_SQL),
    "c4_f9_chunk_pages": (c4_f9_chunk_pages, C4_SQL),
    "f8_pdf_chunks": (f8_pdf_chunks, None),
    "g19_chunk_retention": (g19_retention, G19_SQL),
    "s11_pdf_text": (s11_pdf_text, S11_SQL),
    "g11_pdf_page_stats": (g11_pdf_stats, f"WITH {PDF} SELECT doc, page_no, char_count, word_count, printable_ratio, (char_count < 40 AND image_count > 0) OR (char_count < 20 AND NOT has_text_blocks) OR (printable_ratio < 0.15 AND image_count > 0) AS needs_ocr FROM st"),
    "g10_pdf_mode": (g10_pdf_mode, f"WITH {PDF} SELECT doc, CASE WHEN avg((char_count >= 80)::INT) >= 0.6 THEN 'text_dominant' WHEN avg((char_count <= 20 AND image_count > 0)::INT) >= 0.8 THEN 'scan_dominant' ELSE 'mixed' END AS mode FROM st WHERE page_no <= 5 GROUP BY doc"),
    "g5_run_summary": (g5_run_summary, f"WITH {ROUNDS} SELECT research_id, sum(total)::BIGINT AS total, sum(selected)::BIGINT AS selected, sum(prompted)::BIGINT AS prompted, count(*) AS loops_executed, arg_max(verdict, round) AS last_verdict FROM r GROUP BY research_id"),
    "g6_chunk_summary": (g6_chunk_summary, f"WITH {ROUNDS} SELECT research_id, sum(total)::BIGINT AS total, sum(prompted)::BIGINT AS prompted, sum(selected)::BIGINT AS selected, (sum(prompted) - sum(selected))::BIGINT AS discarded, string_agg(round || ':' || prompted || ':' || selected, '|' ORDER BY round) AS rounds FROM r GROUP BY research_id"),
    "g4_merge_attempts": (g4_merge_attempts, f"WITH {ROUNDS} SELECT research_id, sum(total)::BIGINT AS total, sum(selected)::BIGINT AS selected, string_agg(verdict, ',' ORDER BY round) AS errors, coalesce(string_agg('p' || round || ':' || (round > least_round)::VARCHAR, ',' ORDER BY round) FILTER (selected > 2), '') AS pages, bool_or(verdict = 'sufficient') AND bool_or(selected > 2) AS success, CASE WHEN NOT (bool_or(verdict = 'sufficient') AND bool_or(selected > 2)) THEN array_to_string(CASE WHEN min(round) % 2 = 1 THEN list_filter(['E1', 'E0'], lambda e: list_contains(list('E' || round % 2), e)) ELSE list_filter(['E0', 'E1'], lambda e: list_contains(list('E' || round % 2), e)) END, '; ') END AS error FROM (SELECT *, min(round) OVER (PARTITION BY research_id) AS least_round FROM r) GROUP BY research_id"),
    "p19_completion": (p19_completion, f"WITH {ROUNDS}, a AS (SELECT research_id, (sum(selected) - 9)::BIGINT AS evidence, arg_max(verdict, round) AS verdict FROM r GROUP BY research_id) SELECT *, CASE WHEN evidence <= 0 THEN 'failed' WHEN verdict = 'sufficient' THEN 'complete' ELSE 'partial' END AS state FROM a"),
    "g9_group_sources": (g9_group_sources, f"SELECT research_id, 'q' || query_ordinal AS query, min(source_ordinal * 1000 + position) AS first, string_agg(url, ' ' ORDER BY source_ordinal, position) AS urls FROM ({SERP}) WHERE query_ordinal > 0 GROUP BY research_id, query_ordinal"),
    "g15_content_map": (g15_content_map, f"""WITH p AS (SELECT page_id % {SESSIONS} AS research_id, page_id % 3 + 1 AS round, url, row_number() OVER (PARTITION BY page_id % {SESSIONS}, page_id % 3 ORDER BY page_id) - 1 AS i FROM pages),
g AS (SELECT research_id, round, count(*) AS page_count, string_agg(i || ':' || url, ' ' ORDER BY i) AS guide FROM p GROUP BY ALL), q AS ({QUESTIONS})
SELECT q.research_id, r.round::INT AS round, CASE WHEN q.research_id % 2 = 0 THEN 'academic' ELSE 'web' END AS search_mode, CASE WHEN q.research_id % 3 > 0 THEN 'a|' || question ELSE '' END AS queries, CASE WHEN r.round > 1 THEN CASE WHEN q.research_id % 5 > 0 THEN 'gap' ELSE '' END END AS triggered_by,
 coalesce(page_count, 0) AS page_count, coalesce(guide, '') AS guide FROM q CROSS JOIN (VALUES (1), (2), (3), (4)) r(round) LEFT JOIN g ON g.research_id = q.research_id AND g.round = r.round"""),
    "p20_normalize_request": (p20_normalize, f"SELECT research_id, CASE WHEN research_id % 2 = 0 THEN 'academic' ELSE 'web' END AS search_mode, CASE WHEN research_id % 3 = 0 THEN 'full' ELSE 'fast' END AS mode FROM ({QUESTIONS})"),
    "p21_validate_requests": (p21_validate, f"SELECT research_id, CASE WHEN research_id % 7 = 0 THEN 'question is empty' WHEN research_id % 5 = 1 THEN 'wrong number of queries' WHEN research_id % 3 = 1 THEN 'a query is empty' WHEN research_id % 4 < 1 THEN 'not positive' WHEN research_id % 4 > 2 THEN 'min over max' END AS error FROM ({QUESTIONS})"),
    "p18_route_turns": (p18_route, f"SELECT research_id, CASE WHEN s = 'research' AND research_id % 4 > 0 THEN 'hybrid' ELSE s END AS route FROM (SELECT research_id, CASE WHEN research_id % 6 = 5 THEN 'research' WHEN research_id % 3 = 1 AND research_id % 2 > 0 AND research_id % 4 < 2 THEN 'direct' WHEN research_id % 3 = 0 AND research_id % 5 > 0 THEN 'reuse' ELSE 'research' END AS s FROM ({QUESTIONS}))"),
    "s14_public_payload": (s14_payload, f"""WITH {ROUNDS} SELECT research_id, '{{"total":' || sum(total)::BIGINT || ',"selected":' || sum(selected)::BIGINT || ',"last_verdict":"' || arg_max(verdict, round) || '","note":"none"}}' AS payload FROM r GROUP BY research_id"""),
}
