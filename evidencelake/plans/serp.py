"""Registered queries on search results and selection, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import selection as S
from ..sources.tables import QUESTIONS, SERP, SESSIONS, sessions, table

#: DuckDB text of the canonical URL, for URLs without encoded characters.
def canon(u: str) -> str:
    part = r"regexp_extract({0}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', {1})"
    p = lambda k: part.format(u, k)
    path = f"regexp_replace({p(3)}, ';[^/]*$', '')"
    kept = f"list_sort(list_filter(string_split({p(4)}, '&'), lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(x, '=', 1)) IN ('fbclid','gclid','mc_cid','mc_eid','igshid','ref_src','spm'))))"
    return f"(lower({p(1)}) || '://' || lower({p(2)}) || CASE WHEN {path} IN ('', '/') THEN '/' ELSE rtrim({path}, '/') END || CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END)"


MERGED = f"""s AS ({SERP}), k AS (SELECT *, {canon('url')} AS url_key FROM s),
m AS (SELECT research_id, query_ordinal, url_key, arg_min(url, (source_ordinal, position)) AS url, arg_min(title, (source_ordinal, position)) AS title,
 arg_min(engine, (source_ordinal, position)) AS engine, arg_min(content, (source_ordinal, position)) FILTER (content <> '') AS content,
 arg_min(published_date, (source_ordinal, position)) FILTER (published_date <> '') AS published_date,
 list(engine ORDER BY source_ordinal, position) AS e, list(search_lane ORDER BY source_ordinal, position) AS l, min((source_ordinal, position)) AS o FROM k GROUP BY ALL),
merged AS (SELECT research_id, query_ordinal, url_key, url, title, engine, content, published_date,
 array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') AS source_engines, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS search_lanes,
 row_number() OVER (PARTITION BY research_id, query_ordinal ORDER BY o) AS rank FROM m)"""
#: Picks that a judge could have made: some indices repeat, some do not exist.
PICKS = "p AS (SELECT DISTINCT research_id, query_ordinal AS group_index, i AS pick_ordinal, (i * 7 + research_id) % 9 - 1 AS result_index FROM (SELECT DISTINCT research_id, query_ordinal FROM s) g, (VALUES (0), (1), (2), (3)) t(i))"


def _serp(spark, d):
    return table(spark, d, "serp")


def _merged(spark, d):
    return S.merge_serp(_serp(spark, d))


def _picks(spark, d):
    groups = _serp(spark, d).select("research_id", F.col("query_ordinal").alias("group_index")).distinct()
    i = F.explode(F.array(*map(F.lit, range(4))))
    return groups.select("research_id", "group_index", i.alias("pick_ordinal")).withColumn("result_index", (F.col("pick_ordinal") * 7 + F.col("research_id")) % 9 - 1)


def _seen(spark, d):
    return _serp(spark, d).filter("page_id % 10 = 0").select("research_id", "url")


def _queries(spark, d):
    return _serp(spark, d).select("research_id", "query_ordinal").distinct().withColumn("query", F.concat(F.lit("topic "), "research_id", F.lit(" part "), "query_ordinal"))


Q_SQL = "q AS (SELECT DISTINCT research_id, query_ordinal, concat('topic ', research_id, ' part ', query_ordinal) AS query FROM s)"


def s9_serp(spark, d):
    return _serp(spark, d)


def p1_canonical_url(spark, d):
    return _serp(spark, d).select("page_id", "source_ordinal", urls.canonical_url(F.col("url")).alias("url_key"))


def p2_conversation_url_key(spark, d):
    return _serp(spark, d).select("page_id", "source_ordinal", urls.conversation_url_key(F.col("url")).alias("url_key"))


def p3_p4_domain_host(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_domain(F.col("url")).alias("domain"), urls.url_host(F.col("url")).alias("host"))


def p5_request_url(spark, d):
    return _serp(spark, d).select("page_id", "source_ordinal", urls.request_url(F.col("url")).alias("request_url"))


RISKY = ("https://a.example/x", "http://localhost/x", "ftp://a.example", "http://10.1.2.3/", "http://192.168.0.9:80/a", "https://u:p@a.example/", "http://172.20.0.1/", "http://8.8.8.8/", "http://x.local/", "https:///x")


def p6_screen_urls(spark, d):
    pages = table(spark, d, "pages")
    n = F.pmod(F.col("page_id"), F.lit(len(RISKY) + 1)).cast("int")
    url = F.when(n == len(RISKY), F.col("url")).otherwise(F.get(F.array(*map(F.lit, RISKY)), n))
    return pages.select("page_id", url.alias("url"), urls.url_risk(url).alias("reason"))


P6_SQL = f"""SELECT page_id, u AS url, CASE page_id % 11 WHEN 1 THEN 'local_name' WHEN 2 THEN 'scheme' WHEN 3 THEN 'private_address' WHEN 4 THEN 'private_address' WHEN 5 THEN 'user_info'
 WHEN 6 THEN 'private_address' WHEN 8 THEN 'local_name' WHEN 9 THEN 'no_host' END AS reason FROM (SELECT page_id, CASE WHEN page_id % 11 = 10 THEN url ELSE {list(RISKY)}[page_id % 11 + 1] END AS u FROM pages)"""


def p15_interactive(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_interactive_url(F.col("url")).alias("interactive"))


def p24_thread_key(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.reddit.com/r/a/comments/"), "page_id", F.lit("/t/?x=1"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.is_thread_url(url).alias("is_thread"), urls.thread_key(url).alias("thread_key"))


P24_SQL = r"""SELECT page_id, regexp_matches(lower(u), '^https?://(www\.|old\.)?reddit\.com/r/[^/]+/comments/') AS is_thread, rtrim(regexp_replace(u, '[?#].*$', ''), '/') || '.json' AS thread_key
 FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.reddit.com/r/a/comments/' || page_id || '/t/?x=1' ELSE url END AS u FROM pages)"""


def g1_merge_serp(spark, d):
    return _merged(spark, d).withColumns({c: F.array_join(c, ",") for c in ("source_engines", "search_lanes")})


def w1_c1_search_merge(spark, d):
    return S.search_merge(_serp(spark, d), 3).withColumns({c: F.array_join(c, ",") for c in ("source_engines", "search_lanes")})


def g2_serp_counts(spark, d):
    return S.serp_counts(_serp(spark, d))


def w2_judge_cap(spark, d):
    return S.top_rows(_serp(spark, d), S.KEY, ["source_ordinal", "position"], 4).select("research_id", "query_ordinal", "page_id", "source_ordinal")


def w3_first_by(spark, d):
    rows = _serp(spark, d).withColumn("domain", urls.url_domain(F.col("url")))
    return S.first_by(rows, ["research_id", "domain"], ["query_ordinal", "source_ordinal", "position"], 5, ["research_id"]).select("research_id", "domain", "page_id")


DOMAIN_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"


def w4_top_up(spark, d):
    return S.top_up_picks(_merged(spark, d), _picks(spark, d), 3, 4)


W4_SQL = f"""WITH {MERGED}, {PICKS}, n AS (SELECT research_id, query_ordinal, max(rank) AS n FROM merged GROUP BY ALL),
v AS (SELECT p.research_id, group_index AS query_ordinal, result_index, min(pick_ordinal) AS o FROM p JOIN n ON p.research_id = n.research_id AND p.group_index = n.query_ordinal AND result_index >= 0 AND result_index < n.n GROUP BY ALL),
kk AS (SELECT *, row_number() OVER (PARTITION BY research_id, query_ordinal ORDER BY o) AS i FROM v QUALIFY i <= 4),
h AS (SELECT research_id, query_ordinal, count(*) AS have FROM kk GROUP BY ALL),
r AS (SELECT m.research_id, m.query_ordinal, m.rank - 1 AS result_index, row_number() OVER (PARTITION BY m.research_id, m.query_ordinal ORDER BY m.rank) AS i, coalesce(have, 0) AS have
 FROM merged m LEFT JOIN kk ON m.research_id = kk.research_id AND m.query_ordinal = kk.query_ordinal AND m.rank - 1 = kk.result_index LEFT JOIN h ON m.research_id = h.research_id AND m.query_ordinal = h.query_ordinal WHERE kk.i IS NULL)
SELECT research_id, query_ordinal, result_index, 'picked' AS reason FROM kk UNION ALL SELECT research_id, query_ordinal, result_index, 'coverage fallback' FROM r WHERE i <= 3 - have"""


def j2_exclude_seen(spark, d):
    return S.exclude_seen(_serp(spark, d), _seen(spark, d)).select("research_id", "page_id", "source_ordinal")


def j3_resolve_picks(spark, d):
    return S.resolve_picks(_merged(spark, d), _picks(spark, d), 2).select("research_id", "group_index", "result_index", "url_key")


J3_SQL = f"""WITH {MERGED}, {PICKS}, f AS (SELECT p.*, url_key FROM p JOIN merged m ON p.research_id = m.research_id AND p.group_index = m.query_ordinal AND p.result_index = m.rank - 1),
t AS (SELECT *, row_number() OVER (PARTITION BY research_id, group_index ORDER BY pick_ordinal) AS i FROM f QUALIFY i <= 2)
SELECT research_id, group_index, result_index, url_key FROM t QUALIFY row_number() OVER (PARTITION BY research_id, url_key ORDER BY group_index, pick_ordinal) = 1"""


def j1_provenance(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url"), F.when(F.col("page_id") % 2 == 0, "").otherwise("own").alias("title"), (F.col("page_id") % sessions(spark, d)).alias("research_id"))
    picks = _merged(spark, d).select("research_id", "url", "title", F.concat(F.lit("q"), F.col("query_ordinal").cast("string")).alias("from_query"), F.col("query_ordinal").alias("group_index"), (F.col("rank") - 1).alias("result_index"))
    return S.attach_provenance(pages, picks).drop("url", "research_id")


J1_SQL = f"""WITH {MERGED}, f AS (SELECT research_id, url_key, query_ordinal AS group_index, rank - 1 AS result_index, title FROM merged QUALIFY row_number() OVER (PARTITION BY research_id, url_key ORDER BY query_ordinal DESC, rank DESC) = 1)
SELECT p.page_id, f.group_index, f.result_index, 'q' || f.group_index AS from_query, CASE WHEN p.page_id % 2 = 0 THEN coalesce(f.title, '') ELSE 'own' END AS title FROM pages p LEFT JOIN f ON p.page_id % {SESSIONS} = f.research_id AND {canon('p.url')} = f.url_key"""


def w5_crawl_budget(spark, d):
    cands = _merged(spark, d).select("research_id", F.lit(1).alias("round"), F.col("query_ordinal").cast("int").alias("group_index"), "url", F.row_number().over(S.Window.partitionBy("research_id").orderBy("rank", "query_ordinal")).alias("ordinal"))
    return S.allocate_budget(cands, 6, 9, 11)


#: Three passes over the candidates of a research, folded with what was taken so far.
W5_SQL = f"""WITH {MERGED}, c AS (SELECT research_id, row_number() OVER (PARTITION BY research_id ORDER BY rank, query_ordinal) AS ordinal, query_ordinal AS group_index, url, url_key, {DOMAIN_SQL} AS domain FROM merged),
g AS (SELECT research_id, count(DISTINCT group_index) AS n_groups, least(count(*), 9) AS wanted, list(ordinal ORDER BY ordinal) AS o, list(group_index ORDER BY ordinal) AS gr, list(url_key ORDER BY ordinal) AS k, list(domain ORDER BY ordinal) AS d FROM c GROUP BY research_id),
f AS (SELECT *, list_transform(range(3 * len(o)), lambda i: {{'i': i % len(o) + 1, 'p': i // len(o), 'out': []::BIGINT[], 'why': []::BIGINT[]}}) AS steps FROM g),
r AS (SELECT research_id, list_reduce(steps, lambda a, x: CASE WHEN len(a.out) < CASE x.p WHEN 0 THEN least(n_groups, wanted, 3) ELSE wanted END AND k[x.i] <> '' AND NOT list_contains([k[j] for j in a.out], k[x.i])
 AND (x.p <> 0 OR NOT list_contains([gr[j] for j in a.out], gr[x.i])) AND (x.p <> 1 OR d[x.i] = '' OR len([j for j in a.out if d[j] = d[x.i]]) < 2)
 THEN {{'i': x.i, 'p': x.p, 'out': list_append(a.out, x.i), 'why': list_append(a.why, x.p)}} ELSE a END, {{'i': 0::BIGINT, 'p': 0::BIGINT, 'out': []::BIGINT[], 'why': []::BIGINT[]}}) AS z FROM f),
e AS (SELECT research_id, unnest(z.out) AS ordinal, generate_subscripts(z.out, 1) - 1 AS slot, unnest(z.why) AS p FROM r)
SELECT e.research_id, 1 AS round, ordinal, group_index, url, url_key, domain, slot, ['coverage', 'domain', 'fill'][p + 1] AS pass FROM e JOIN c USING (research_id, ordinal)"""


def w6_diversity(spark, d):
    return S.diversity_quota(_merged(spark, d), 4, 1, 2).select("research_id", "query_ordinal", "url_key", "slot")


#: The results of a query twice: what the engine quota refused comes again without it.
W6_SQL = f"""WITH {MERGED}, g AS (SELECT research_id, query_ordinal, list(url_key ORDER BY rank) AS k, list(lower(trim(engine)) ORDER BY rank) AS e, list({DOMAIN_SQL} ORDER BY rank) AS d FROM merged GROUP BY ALL),
f AS (SELECT *, list_transform(range(2 * len(k)), lambda i: {{'i': i % len(k) + 1, 'p': i // len(k), 'out': []::BIGINT[]}}) AS steps FROM g),
r AS (SELECT research_id, query_ordinal, k, list_reduce(steps, lambda a, x: CASE WHEN len(a.out) < 4 AND NOT list_contains(a.out, x.i) AND (x.p = 1 OR len([j for j in a.out if e[j] = e[x.i]]) < 1) AND (d[x.i] = '' OR len([j for j in a.out if d[j] = d[x.i]]) < 2)
 THEN {{'i': x.i, 'p': x.p, 'out': list_append(a.out, x.i)}} ELSE a END, {{'i': 0::BIGINT, 'p': 0::BIGINT, 'out': []::BIGINT[]}}).out AS taken FROM f)
SELECT research_id, query_ordinal, k[i] AS url_key, slot FROM (SELECT research_id, query_ordinal, k, unnest(taken) AS i, generate_subscripts(taken, 1) - 1 AS slot FROM r)"""


def w6_domain_quota(spark, d):
    return S.diversity_quota(_merged(spark, d), 4, None, 1).select("research_id", "query_ordinal", "url_key", "slot")


W6D_SQL = f"""WITH {MERGED}, a AS (SELECT *, row_number() OVER (PARTITION BY research_id, query_ordinal, {DOMAIN_SQL} ORDER BY rank) AS n FROM merged QUALIFY n <= 1),
b AS (SELECT *, row_number() OVER (PARTITION BY research_id, query_ordinal ORDER BY rank) - 1 AS slot FROM a) SELECT research_id, query_ordinal, url_key, slot FROM b WHERE slot < 4"""


def w7_redistribute(spark, d):
    apis = F.array(*map(F.lit, ("searxng", "brave", "tavily", "exa")))
    base = _serp(spark, d).groupBy("research_id").agg((F.count("*") * 3).alias("total"))
    rows = base.select("research_id", "total", F.posexplode(apis).alias("ordinal", "api")).withColumn("per_query", F.when(F.col("api") == "searxng", 1).otherwise(F.col("research_id") % 7))
    return S.redistribute_quota(rows, F.col("total"))


#: Each step deals what is left evenly to the sources below their cap, the first ones get the rest.
W7_SQL = f"""WITH RECURSIVE s AS ({SERP}), c AS (SELECT ['searxng', 'brave', 'tavily', 'exa'] AS apis, [1, 20, 20, 100] AS caps),
t AS (SELECT research_id, count(*) * 3 AS rest, [1, research_id % 7, research_id % 7, research_id % 7]::BIGINT[] AS q FROM s GROUP BY research_id
 UNION ALL SELECT research_id, rest - list_sum(given), list_transform(q, lambda x, i: x + given[i]) FROM (SELECT research_id, rest, q, list_transform(q, lambda x, i: CASE WHEN o[i] = 1 THEN least(rest // list_sum(o) + CASE WHEN list_sum(o[1:i]) <= rest % list_sum(o) THEN 1 ELSE 0 END, caps[i] - x) ELSE 0 END)::BIGINT[] AS given
  FROM (SELECT t.*, caps, list_transform(q, lambda x, i: CASE WHEN x < caps[i] THEN 1 ELSE 0 END) AS o FROM t, c) WHERE rest > 0 AND list_sum(o) > 0)),
e AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY research_id ORDER BY rest, list_sum(q) DESC) = 1)
SELECT research_id, i - 1 AS ordinal, apis[i] AS api, q[i] AS per_query, caps[i] AS cap FROM e, c, (VALUES (1), (2), (3), (4)) v(i)"""


def w8_u_order(spark, d):
    pages = table(spark, d, "crawl_log").filter("success").select("research_id", "page_id", F.when(F.col("page_id") % 4 != 0, (F.col("page_id") * 7) % 13).alias("importance"))
    return S.u_order(pages, "importance", "page_id").select("research_id", "page_id", "slot")


W8_SQL = f"""WITH a AS (SELECT page_id % {SESSIONS} AS research_id, page_id, CASE WHEN page_id % 4 <> 0 THEN (page_id * 7) % 13 END AS imp FROM pages WHERE page_id % 5 < 3),
b AS (SELECT *, count(*) OVER w AS n, count(imp) OVER w AS k, row_number() OVER (PARTITION BY research_id ORDER BY imp ASC NULLS LAST, page_id) - 1 AS i, row_number() OVER (PARTITION BY research_id ORDER BY page_id) - 1 AS own FROM a WINDOW w AS (PARTITION BY research_id))
SELECT research_id, page_id, CASE WHEN n <= 2 OR k = 0 THEN own WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS slot FROM b"""


def u2_carryover(spark, d):
    return S.carryover(_merged(spark, d), _seen(spark, d), _queries(spark, d), "earlier", 3).select("research_id", "group_index", "label", "url_key")


U2_SQL = f"""WITH {MERGED}, {Q_SQL}, x AS (SELECT DISTINCT research_id, {canon('url')} AS url_key FROM s WHERE page_id % 10 = 0),
l AS (SELECT m.* FROM merged m ANTI JOIN x ON m.research_id = x.research_id AND m.url_key = x.url_key), c AS (SELECT *, row_number() OVER (PARTITION BY research_id, query_ordinal ORDER BY rank) AS i FROM l QUALIFY i <= 3)
SELECT c.research_id, dense_rank() OVER (PARTITION BY c.research_id ORDER BY c.query_ordinal) - 1 AS group_index, 'earlier: ' || query AS label, url_key FROM c JOIN q ON c.research_id = q.research_id AND c.query_ordinal = q.query_ordinal"""


def u6_site_queries(spark, d):
    return S.site_queries(_queries(spark, d))


U6_SQL = f"""WITH s AS ({SERP}), {Q_SQL}, c AS (SELECT * FROM (VALUES (0, '(site:ptt.cc OR site:dcard.tw OR site:mobile01.com OR site:forum.gamer.com.tw)'), (1, '(site:reddit.com OR site:news.ycombinator.com OR site:lemmy.world OR site:mastodon.social)')) t(site_ordinal, clause))
SELECT research_id, query_ordinal, site_ordinal, query || ' ' || clause AS site_query FROM q, c QUALIFY row_number() OVER (PARTITION BY research_id ORDER BY query_ordinal, site_ordinal) <= 3"""


def u4_next_queries(spark, d):
    q = _queries(spark, d).groupBy("research_id").agg(S.ordered(F.col("query"), ["query_ordinal"]).alias("default_queries"))
    reviews = q.withColumn("next_search_queries", F.array(F.concat(F.lit("more on "), "research_id"), F.element_at("default_queries", 1)))
    return S.next_queries(reviews, 3).withColumn("queries", F.array_join("queries", "|"))


U4_SQL = f"""WITH s AS ({SERP}), {Q_SQL}, r AS (SELECT research_id, list(query ORDER BY query_ordinal) AS d FROM q GROUP BY ALL), u AS (SELECT research_id, list_concat(['more on ' || research_id, d[1]], d) AS a FROM r)
SELECT research_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:3], '|') AS queries FROM u"""


def u5_missing_focus(spark, d):
    r = table(spark, d, "questions").select("research_id", F.when(F.col("research_id") % 3 > 0, F.slice(F.split("question", " "), 1, 8)).alias("missing"), F.lit("gap").alias("gap_analysis"))
    return S.missing_focus(r).withColumn("focus", F.array_join("focus", "|"))


U5_SQL = f"SELECT research_id, CASE WHEN research_id % 3 > 0 THEN array_to_string(string_split(question, ' ')[1:6], '|') ELSE 'gap' END AS focus FROM ({QUESTIONS})"

QUERIES = {
    "s9_u1_serp": (s9_serp, SERP),
    "p1_canonical_url": (p1_canonical_url, f"WITH s AS ({SERP}) SELECT page_id, source_ordinal, {canon('url')} AS url_key FROM s"),
    "p2_conversation_url_key": (p2_conversation_url_key, rf"WITH s AS ({SERP}) SELECT page_id, source_ordinal, rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '\?([^#]*)', 1) END AS url_key FROM s"),
    "p3_p4_domain_host": (p3_p4_domain_host, f"SELECT page_id, {DOMAIN_SQL} AS domain, split_part(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), ':', 1) AS host FROM pages"),
    "p5_request_url": (p5_request_url, f"WITH s AS ({SERP}) SELECT page_id, source_ordinal, trim(url) AS request_url FROM s"),
    "p6_screen_urls": (p6_screen_urls, P6_SQL),
    "p15_interactive": (p15_interactive, r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(^|[/_.-])(topic|thread|discussion|discuss|forum|forums|comment|comments|reply|replies|post|posts|question|questions|answer|answers|talk|community)($|[/_.-])') OR regexp_matches(regexp_extract(url, '\?([^#]*)', 1), '(^|&)(comment|comments|reply|thread|topic|discussion|post|question)=') AS interactive FROM pages"),
    "p24_thread_key": (p24_thread_key, P24_SQL),
    "g1_merge_serp": (g1_merge_serp, f"WITH {MERGED} SELECT * FROM merged"),
    "w1_c1_search_merge": (w1_c1_search_merge, f"WITH {MERGED} SELECT * FROM merged WHERE rank <= 3"),
    "g2_serp_counts": (g2_serp_counts, f"WITH {MERGED} SELECT s.research_id, count(*) AS raw_total, (SELECT count(*) FROM merged m WHERE m.research_id = s.research_id) AS total FROM s GROUP BY s.research_id"),
    "w2_judge_cap": (w2_judge_cap, f"WITH s AS ({SERP}) SELECT research_id, query_ordinal, page_id, source_ordinal FROM s QUALIFY row_number() OVER (PARTITION BY research_id, query_ordinal ORDER BY source_ordinal, position) <= 4"),
    "w3_first_by": (w3_first_by, f"WITH s AS ({SERP}), f AS (SELECT *, {DOMAIN_SQL} AS domain FROM s QUALIFY row_number() OVER (PARTITION BY research_id, domain ORDER BY query_ordinal, source_ordinal, position) = 1) SELECT research_id, domain, page_id FROM f QUALIFY row_number() OVER (PARTITION BY research_id ORDER BY query_ordinal, source_ordinal, position) <= 5"),
    "w4_top_up_picks": (w4_top_up, W4_SQL),
    "j1_provenance": (j1_provenance, J1_SQL),
    "j2_exclude_seen": (j2_exclude_seen, f"WITH s AS ({SERP}), x AS (SELECT DISTINCT research_id AS r, {canon('url')} AS k FROM s WHERE page_id % 10 = 0) SELECT research_id, page_id, source_ordinal FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE r = research_id AND k = {canon('url')})"),
    "j3_resolve_picks": (j3_resolve_picks, J3_SQL),
    "w5_crawl_budget": (w5_crawl_budget, W5_SQL),
    "w6_diversity_quota": (w6_diversity, W6_SQL),
    "w6_domain_quota": (w6_domain_quota, W6D_SQL),
    "w7_redistribute_quota": (w7_redistribute, W7_SQL),
    "w8_u_order": (w8_u_order, W8_SQL),
    "u2_carryover": (u2_carryover, U2_SQL),
    "u4_next_queries": (u4_next_queries, U4_SQL),
    "u5_missing_focus": (u5_missing_focus, U5_SQL),
    "u6_site_queries": (u6_site_queries, U6_SQL),
}
