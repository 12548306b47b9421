"""Jobs made of the operators: one round's crawl list, evidence selection, and research over up to three rounds.

A round works on all sessions at once: a session whose verdict suffices is filtered out, never
looped over. Each round's evidence can be written by the caller's ``keep`` (a table in shared
storage), which keeps lineage short; there are three rounds at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import querylang as L
from ..functions import text as T
from ..functions.urls import canonical_url
from ..sources.tables import written
from . import chunks as K
from . import conversations as V
from . import judging as J
from . import pages as P
from . import reports as R
from . import selection as S
from .extraction import read_pages


def search_results(queries: DataFrame, responses: DataFrame, sources: list[dict], search_mode: str = "web", most: int = C.RESULTS_PER_QUERY, engine_quota: int | None = None, domain_quota: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Result set of a round, and its counts: each query is planned for each source, the rows that the source gave are merged by URL, put under the quotas and cut to ``most`` of a query.

    queries: research_id, question, query_ordinal, query; responses: result rows (research_id, query_ordinal, source_ordinal,
    position, url, ...); sources as of ``querylang.plan_queries``. Rows of sources that are not planned take no part. The result
    has rank (the place in its query) and query, the counts are of all that took part.
    """
    plans = L.plan_queries(queries, L.query_profile(queries), sources, search_mode)
    given = responses.join(plans.select("research_id", "query_ordinal", "source_ordinal"), ["research_id", "query_ordinal", "source_ordinal"], "left_semi")
    merged = S.merge_serp(given)
    kept = S.diversity_quota(merged, most, engine_quota, domain_quota).withColumn("rank", F.col("slot") + 1).drop("slot") if engine_quota or domain_quota else merged.filter(F.col("rank") <= most)
    return kept.join(queries.select("research_id", "query_ordinal", "query"), ["research_id", "query_ordinal"]), S.serp_counts(given)


def url_selection(
    serp: DataFrame, replies: DataFrame | None, seen: DataFrame, least: int, most: int, budget: tuple[int, int, int], round_: int = 1, spent: DataFrame | None = None,
    ask: Callable[[Column], Column] | None = None, asked: tuple[DataFrame, DataFrame] | None = None, judged: int = 0,
) -> DataFrame:
    """Crawl list of a round from merged results: the judge's picks (or the first results), topped up, resolved, without what was seen, under the budget less what was ``spent`` (research_id, spent) of it.

    The judge sees the first ``judged`` results of each query (0: all). It is a table of replies, or ``ask``, a function of the
    prompt, which is then made of ``asked`` (questions: research_id, question; queries: research_id, query_ordinal, query).
    Topping up looks at all results.
    """
    shown = S.top_rows(serp, S.KEY, ["rank"], judged)
    if ask is not None:
        replies = J.judge(J.url_prompts(shown, *asked), ask)
    picks = J.parse_url_picks(replies, shown, least, most)
    topped = S.top_up_picks(serp, picks, least, most).withColumn("pick_ordinal", F.row_number().over(Window.partitionBy("research_id", "query_ordinal").orderBy(F.desc("reason"), "result_index")))
    resolved = S.resolve_picks(serp, topped.withColumnRenamed("query_ordinal", "group_index"), most)
    left = S.exclude_seen(resolved, seen)
    order = F.row_number().over(Window.partitionBy("research_id").orderBy("pick_ordinal", "group_index"))
    rows = left.select("research_id", F.lit(round_).alias("round"), F.col("group_index").cast("int").alias("group_index"), "url", order.alias("ordinal"))
    return S.allocate_budget(rows if spent is None else rows.join(spent, "research_id", "left"), *budget)


def select_evidence(chunks: DataFrame, replies: DataFrame, n: int = C.FALLBACK_CHUNKS) -> DataFrame:
    """chunks with pick and verdict: what the judge named, and for sessions where that is nothing, the choice without a judge."""
    reviews = J.parse_chunk_reviews(replies)
    named = K.valid_selected_ids(reviews, chunks)
    judged = chunks.join(named, ["research_id", "chunk_id"])
    rest = K.fallback_chunks(chunks.join(named.select("research_id").distinct(), "research_id", "left_anti"), n)
    return judged.unionByName(rest).join(reviews.select("research_id", "verdict"), "research_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("insufficient")))


ROUNDS = {"instant": ("instant",), "fast": ("fast", "fast_second"), "full": ("full", "full", "narrow")}


def _asked(later: DataFrame | None, queries: DataFrame) -> DataFrame | None:
    """Merged archived results (research_id, query, ...) of queries (research_id, query_ordinal, query)."""
    return None if later is None else S.search_merge(later.join(queries.select("research_id", "query_ordinal", "query"), ["research_id", "query"]).drop("query"))


def next_round(reviews: DataFrame, asked: DataFrame, merged: DataFrame, seen: DataFrame, later: DataFrame | None, most: int, carry: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """Queries and result groups of a further round.

    Queries are the reviewer's, then the last round's (asked), ``most`` in all; their groups come from the
    archived results of later queries, and after them, with ``carry``, what is unread of earlier groups.
    """
    default = asked.groupBy("research_id").agg(S.ordered(F.col("query"), ["query_ordinal"]).alias("default_queries"))
    queries = S.next_queries(reviews.join(default, "research_id"), most).select("research_id", F.posexplode("queries").alias("query_ordinal", "query"))
    groups = _asked(later, queries)
    if carry or groups is None:
        old = S.carryover(merged.join(queries.select("research_id").distinct(), "research_id", "left_semi"), seen, asked, label).withColumn("query_ordinal", F.col("group_index").cast("int") + most)
        named = old.select("research_id", "query_ordinal", F.col("label").alias("query")).distinct()
        old = old.select(*merged.columns).withColumn("rank", F.row_number().over(Window.partitionBy("research_id", "query_ordinal").orderBy("rank")))
        groups = old if groups is None else groups.unionByName(old, allowMissingColumns=True)
        queries = queries.unionByName(named)
    return queries, groups


def research(
    serp: DataFrame, archive: DataFrame, questions: DataFrame, mode: str = "fast", url_replies: DataFrame | None = None, chunk_replies: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = written, queries: DataFrame | None = None, later: DataFrame | None = None, search_mode: str = "web", refresh: DataFrame | None = None,
) -> DataFrame:
    """Evidence of every session after the rounds of its mode.

    serp: result rows; archive: research_id, url, title, text of pages that can be read; replies by
    research_id and, where there is one, ``round``; queries: research_id, query_ordinal, query of the first
    round (else the question stands for each); later: result rows with ``query`` for what later rounds and the
    site fallback ask. A round after the first asks what the review wants (``next_round``); fast rounds, and
    all where nothing later is archived, also read on in earlier groups. Social sessions with few pages after
    round 1 search named sites within the budget that is left. Pages to read again (refresh: research_id, url)
    come before those of round 1. ``focus`` is what the review before a round missed. ``keep`` ends the lineage of what a round
    hands on, by default with a table in the shared folder, so the plan of a round does not hold those before it.
    """
    merged = keep(S.search_merge(serp), "serp")
    pages = keep(archive.withColumn("url_key", canonical_url(F.col("url"))), "archive")
    asked = queries if queries is not None else merged.select("research_id", "query_ordinal").distinct().join(questions.select("research_id", F.col("question").alias("query")), "research_id")
    no_reply = questions.select("research_id", F.lit(None).cast("string").alias("reply"))
    focus = questions.select("research_id", F.array().cast("array<string>").alias("focus"))
    open_, seen, done, reviews = questions.select("research_id"), None, None, None
    for k, name in enumerate(ROUNDS[mode], start=1):
        at = lambda r: no_reply if r is None else no_reply.drop("reply").join(r.filter(F.col("round") == k).select("research_id", "reply") if "round" in r.columns else r, "research_id", "left")  # noqa: E731,B023
        if k == 1:
            groups, tried = merged, merged.limit(0).select("research_id", "url")
        else:
            focus = S.missing_focus(reviews)
            now, groups = next_round(reviews.join(open_, "research_id", "left_semi"), asked, groups, seen, later, 2 if name == "narrow" else 3, mode == "fast", f"round {k - 1}")
            asked, groups, tried = keep(now, f"asked{k}"), keep(groups, f"groups{k}"), seen
        limits = (1, 3) if (mode, k) == ("fast", 2) else (4, 9)
        crawl = keep(url_selection(groups.join(open_, "research_id", "left_semi"), at(url_replies), tried, *limits, C.BUDGETS[name], k), f"crawl{k}")
        read = crawl.select("research_id", "slot", "url_key").join(pages, ["research_id", "url_key"]).select("research_id", F.col("slot").alias("page_order"), "url_key", "url", "title", "text")
        if k == 1 and refresh is not None:
            again = refresh.select("research_id", canonical_url(F.col("url")).alias("url_key")).distinct().join(pages, ["research_id", "url_key"])
            order = F.row_number().over(Window.partitionBy("research_id").orderBy("url_key"))
            read = V.merge_refreshed(read, again.select("research_id", order.cast("long").alias("page_order"), "url_key", "url", "title", "text"))
        if k == 1 and mode != "instant" and search_mode == "social" and later is not None:
            got = questions.select("research_id").join(crawl.groupBy("research_id").agg(F.count("*").alias("selected")), "research_id", "left").join(read.groupBy("research_id").agg(F.count("*").alias("pages")), "research_id", "left").na.fill(0)
            few = P.needs_social_fallback(got).filter((F.col("pages") == 0) | F.col("fallback"))
            sites = S.site_queries(asked.join(few, "research_id", "left_semi")).select("research_id", F.row_number().over(Window.partitionBy("research_id").orderBy("query_ordinal", "site_ordinal")).alias("query_ordinal"), F.col("site_query").alias("query"))
            taken = crawl.select("research_id", "url")
            more = keep(url_selection(_asked(later, sites), no_reply, taken, *limits, C.BUDGETS[name], k, few.select("research_id", F.col("selected").alias("spent"))), "fallback")
            added = more.select("research_id", "slot", "url_key").join(pages, ["research_id", "url_key"])
            read = read.unionByName(added.select("research_id", (F.col("slot") + 1000).alias("page_order"), "url_key", "url", "title", "text"))
            crawl = crawl.unionByName(more)
        seen = crawl.select("research_id", "url") if seen is None else seen.unionByName(crawl.select("research_id", "url"))
        place = F.row_number().over(Window.partitionBy("research_id").orderBy("page_order"))
        chunked = K.chunk_pages(read.join(questions, "research_id").withColumns({"source_ordinal": place.cast("int"), "from_query": F.lit(""), "resource_type": F.lit("html")}).drop("page_order"), k)
        chosen = keep(select_evidence(chunked, at(chunk_replies)).join(focus, "research_id", "left"), f"evidence{k}")
        done = chosen if done is None else done.unionByName(chosen)
        reviews = J.parse_chunk_reviews(at(chunk_replies))
        enough = chosen.filter("verdict = 'sufficient'").select("research_id").distinct()
        open_ = open_.join(enough, "research_id", "left_anti")
    once = S.first_by(done, ["research_id", "chunk_id"], ["round", "pick"]).withColumn("pick", F.row_number().over(Window.partitionBy("research_id").orderBy("round", "pick")))
    order = F.row_number().over(Window.partitionBy("research_id").orderBy("url_key"))
    return K.evidence_join(pages.withColumn("page_order", order).select("research_id", "page_order", "url", "title"), once)


def research_summary(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """research_id, sources, chunks, rounds, verdict, state."""
    counts = evidence.groupBy("research_id").agg(F.max("source_index").alias("sources"), F.count("*").alias("evidence"), F.max("round").alias("rounds"), F.max_by("verdict", F.struct("round", "pick")).alias("verdict"))
    every = questions.select("research_id").join(counts, "research_id", "left").withColumns({"evidence": F.coalesce("evidence", F.lit(0)), "verdict": F.coalesce("verdict", F.lit("insufficient"))})
    return R.completion_state(every)


def page_texts(pages: DataFrame) -> DataFrame:
    """url, title, text and the columns besides html of pages (page_id, url, html) whose text is usable, read in both modes."""
    read = read_pages(pages.select("page_id", "url", "html")).filter("quality.usable").select("page_id", "title", "text")
    return pages.drop("html").join(read, "page_id").drop("page_id")


def prior_sources(capsules: DataFrame) -> DataFrame:
    """Sources of opened capsules (conv_id, at, turn_id, evidence): conv_id, recency (0 for the latest turn), source_order, title, url, chunks."""
    late = F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.desc("at"))) - 1
    rows = capsules.withColumn("recency", late).select("conv_id", "recency", F.posexplode(V.clean_evidence(F.col("evidence"), F.col("turn_id"))).alias("i", "s"))
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("recency", "i"))
    return rows.select("conv_id", "recency", order.alias("source_order"), "s.title", "s.url", "s.chunks")


def refreshes(capsules: DataFrame, refs: DataFrame, direct: DataFrame) -> DataFrame:
    """conv_id, source_ref, title, url of the sources that a turn asks to read again, but for those that its message names."""
    ledger = V.research_ledger(capsules).select("conv_id", F.explode("sources").alias("s")).select("conv_id", "s.*")
    return V.exclude_sources(V.refreshable_sources(ledger, refs), direct.select("conv_id", "url"))


def followup(turns: DataFrame, capsules: DataFrame, refs: DataFrame, direct: DataFrame, found: DataFrame, budget: int = C.REUSE_TOKENS) -> DataFrame:
    """Evidence of follow-up turns by their route: conv_id, route, source_index, title, url, chunks, citation_id, citation_marker.

    turns: conv_id, question, strategy, force_research, pages_read, verdict, explicit_urls; capsules: opened ones of
    earlier turns; refs: conv_id, ordinal, source_ref to read again; direct and found: sources (conv_id, source_order,
    title, url, chunks) of the message's own URLs and of this turn's research. A turn that reuses has the earlier
    sources that fit its question and the budget, a direct one those of its message, others both kinds of new
    sources, then the earlier ones that were not read again. A turn without evidence has one row with nulls.
    """
    packed = V.relevant_prior(prior_sources(capsules), turns.select("conv_id", "question"), budget)
    prior = packed.groupBy("conv_id", F.col("source_rank").alias("source_order")).agg(F.first("title").alias("title"), F.first("url").alias("url"), S.ordered(F.struct("chunk_id", "text"), ["chunk_rank"]).alias("chunks"))
    again = refreshes(capsules, refs, direct)
    n = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    counted = turns
    for df, name in ((prior, "prior_evidence"), (direct, "direct_evidence"), (again, "refresh_urls")):
        counted = counted.join(n(df, name), "conv_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    routed = R.route_turns(counted).select("conv_id", "route")
    own = ["conv_id", "source_order", "title", "url", "chunks"]
    of = lambda df, *routes: df.select(*own).join(routed.filter(F.col("route").isin(*routes)), "conv_id", "left_semi")
    fresh = of(direct, "direct", "research", "hybrid").unionByName(of(found, "research", "hybrid").withColumn("source_order", F.col("source_order") + 1_000_000))
    reread = direct.select("conv_id", "url").unionByName(again.select("conv_id", "url"))
    old = of(prior, "reuse").unionByName(of(V.exclude_sources(prior, reread), "research", "hybrid"))
    return routed.join(V.merge_evidence(fresh, old).drop("_p", "source_order"), "conv_id", "left")


def seal_turns(evidence: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """turn_id, token: the evidence of turns (conv_id, turn_id, question, queries) as capsules for the turns after them."""
    kept = evidence.filter("source_index is not null").groupBy("conv_id").agg(S.ordered(F.struct("title", "url", "chunks"), ["source_index"]).alias("evidence"))
    return V.seal_capsules(turns.join(kept, "conv_id").select("turn_id", F.col("question").alias("standalone_question"), "queries", "evidence"), key)
