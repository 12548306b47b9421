"""Registered jobs: crawl lists, evidence, research over rounds, follow-up turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import conversations as V
from ..operators import jobs
from ..operators import judging as J
from ..sources.tables import SESSIONS, sessions, table
from .chunks import CHUNKS, _chunks
from .conversations import KEY, _capsules, _sources
from .providers import S17_SQL, _replies, s17_url_prompts
from .serp import W6_SQL, _merged, _queries, _seen


def c2_url_selection(spark, d):
    return jobs.url_selection(_merged(spark, d), _replies(spark, d), _seen(spark, d), 4, 9, (6, 9, 11))


def c1_search_results(spark, d):
    """Two sources under quotas of one result an engine and two a domain, four a query."""
    queries = _queries(spark, d).join(table(spark, d, "questions"), "research_id")
    found, _ = jobs.search_results(queries, table(spark, d, "serp"), [{"api": "brave"}, {"api": "exa"}], most=4, engine_quota=1, domain_quota=2)
    return found.select("research_id", "query_ordinal", "url_key", (F.col("rank") - 1).alias("slot"))


def c2_judged_selection(spark, d):
    """The crawl list where the judge is a function of the prompt, which shows it three results of a query."""
    say = lambda prompt: F.concat(F.lit('I take {"selected": [{"group_index": 1, "result_indices": [2, '), (F.length(prompt) % 3).cast("string"), F.lit(", 7]}]}"))
    asked = table(spark, d, "questions"), _queries(spark, d)
    return jobs.url_selection(_merged(spark, d).withColumn("relevance_score", F.lit(0.5)), None, _seen(spark, d), 2, 3, (6, 9, 11), ask=say, asked=asked, judged=3)


def x4_judge(spark, d):
    """What a judge that is a function says to the prompts of S17, and what a table of replies has for them."""
    prompts = s17_url_prompts(spark, d)
    said = J.judge(prompts, lambda p: F.concat(F.lit("n="), F.length(p).cast("string")))
    known = J.judge(prompts, replies=_replies(spark, d).filter("research_id % 2 = 0"))
    return said.select("research_id", "reply").join(known.select("research_id", F.col("reply").alias("known")), "research_id")


X4_SQL = f"""SELECT research_id, 'n=' || length(prompt) AS reply, CASE WHEN research_id % 2 = 0 THEN CASE WHEN research_id % 3 > 0 THEN 'Sure: {{"selected": [{{"group_index": 1, "result_indices": [2, 0, 99, -1, 1]}}, {{"group_index": 9, "result_indices": [0]}}]}} ok' ELSE 'no json' END END AS known FROM ({S17_SQL})"""


def c5_select_evidence(spark, d):
    reply = F.concat(F.lit('{"chunk_ids": ["L1-S'), F.col("research_id") + sessions(spark, d), F.lit('-C001"], "verdict": "yes"}'))
    replies = table(spark, d, "questions").select("research_id", F.when(F.col("research_id") % 2 == 0, reply).alias("reply"))
    return jobs.select_evidence(_chunks(spark, d), replies).select("research_id", "chunk_id", "pick", "verdict")


#: Sessions of an even number have a reply, which names one chunk, if it is there; all others have the choice without a judge.
C5_SQL = f"""WITH {CHUNKS}, n AS (SELECT c.research_id, chunk_id FROM chunks c JOIN q0 ON c.research_id = q0.research_id WHERE c.research_id % 2 = 0 AND source_ordinal = c.research_id + {SESSIONS} AND chunk_ordinal = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY research_id, source_ordinal ORDER BY chunk_ordinal) = 1 AS head FROM chunks WHERE research_id NOT IN (SELECT research_id FROM n)),
f AS (SELECT research_id, chunk_id, row_number() OVER (PARTITION BY research_id ORDER BY head DESC, CASE WHEN head THEN 0 ELSE -score END, source_ordinal, chunk_ordinal) AS pick FROM h QUALIFY pick <= 12),
b AS (SELECT research_id, chunk_id, 1 AS pick FROM n UNION ALL SELECT * FROM f) SELECT *, CASE WHEN research_id % 2 = 0 THEN 'sufficient' ELSE 'insufficient' END AS verdict FROM b"""


def _research(spark, d, mode, search_mode="web"):
    pages = table(spark, d, "pages").select((F.col("page_id") % sessions(spark, d)).alias("research_id"), "page_id", "url", "html")
    replies = table(spark, d, "questions").select("research_id", F.when(F.col("research_id") % 2 == 0, '{"verdict": "sufficient", "chunk_ids": ["L1-S1-C001", "L1-S2-C001"]}').otherwise('{"verdict": "insufficient", "chunk_ids": ["L1-S1-C001"], "next_search_queries": ["more"], "coverage": {"missing": ["numbers"]}}').alias("reply"))
    questions, asked = table(spark, d, "questions"), _queries(spark, d)
    every = table(spark, d, "serp")
    wants = F.when(F.col("position") % 2 == 0, "more").otherwise(F.concat(F.col("query"), F.lit(" (site:reddit.com OR site:news.ycombinator.com OR site:lemmy.world OR site:mastodon.social)")))
    later = every.join(asked, ["research_id", "query_ordinal"]).withColumn("query", wants).drop("query_ordinal")
    refresh = every.filter("position = 1 and source_ordinal = 0").select("research_id", "url")
    return jobs.research(every, jobs.page_texts(pages), questions, mode, chunk_replies=replies, queries=asked, later=later, search_mode=search_mode, refresh=refresh), questions


def c6_research_fast(spark, d):
    return _research(spark, d, "fast")[0].select("research_id", "round", "source_index", "chunk_id", "citation_marker", "verdict", F.array_join("focus", "|").alias("focus"))


def c6_research_full(spark, d):
    return jobs.research_summary(*_research(spark, d, "full"))


def c6_research_social(spark, d):
    return jobs.research_summary(*_research(spark, d, "fast", "social"))


def c9_followup(spark, d):
    """Follow-up turns of all conversations over documents: route, sources by origin, and a capsule for the turns after."""
    capsules = _capsules(spark, d)
    conv = capsules.select("conv_id").distinct()
    n = F.col("conv_id")
    turns = conv.join(table(spark, d, "benchmark").withColumn("n", F.count("*").over(Window.partitionBy())).select("item_id", "n", "text"), n % F.col("n") == F.col("item_id"))
    turns = turns.select("conv_id", F.concat(F.lit("t9-"), "conv_id").alias("turn_id"), F.col("text").alias("question"), F.array(F.lit("q")).alias("queries"), (n % 9 == 8).alias("force_research"), F.when(n % 3 == 0, "reuse").when(n % 3 == 1, "direct").otherwise("research").alias("strategy"), (n % 3 == 1).cast("int").alias("pages_read"), F.when(n % 2 == 0, "sufficient").otherwise("insufficient").alias("verdict"), (n % 3 == 1).cast("int").alias("explicit_urls"))
    refs = conv.filter(n % 5 == 1).select("conv_id", F.lit(0).alias("ordinal"), F.lit("t1:S2").alias("source_ref"))
    s = _sources(spark, d)
    direct, found = s.filter((n % 3 == 1) & (F.col("source_order") % 20 == 3)), s.filter(F.col("source_order") % 20 < 2)
    evidence = jobs.followup(turns, capsules, refs, direct, found)
    sealed = V.unseal_capsules(jobs.seal_turns(evidence, turns, KEY).select(F.regexp_extract("turn_id", "([0-9]+)$", 1).cast("long").alias("conv_id"), F.lit(0).alias("at"), "token"), KEY)
    shown = evidence.groupBy("conv_id", "route").agg(F.count("source_index").alias("n_sources"), F.sum(F.size("chunks")).alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_index", "url"))), lambda x: x["url"]), " ").alias("urls"))
    return shown.join(sealed.select("conv_id", F.size("evidence").alias("sealed")), "conv_id", "left")


QUERIES = {
    "c1_search_results": (c1_search_results, W6_SQL),
    "c2_judged_selection": (c2_judged_selection, None),
    "c2_url_selection": (c2_url_selection, None),
    "x4_judge": (x4_judge, X4_SQL),
    "c5_select_evidence": (c5_select_evidence, C5_SQL),
    "c6_research_fast": (c6_research_fast, None),
    "c6_research_full": (c6_research_full, None),
    "c6_research_social": (c6_research_social, None),
    "c9_followup": (c9_followup, None),
}
