"""Merging, selecting and ordering result rows. Order is always carried by columns: Spark has no list order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.urls import canonical_url, url_domain

KEY = ["research_id", "query_ordinal"]


def ordered(column: Column, order: list[str]) -> Column:
    """Values of a group in the order of other columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, column.alias("v")))), lambda x: x["v"])


def first_by(df: DataFrame, key: list[str], order: list[str], limit: int | None = None, within: list[str] | None = None) -> DataFrame:
    """The first row of each key, in order; with ``within`` and ``limit``, the first so many of those of each group."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return out if limit is None else top_rows(out, within or [], order, limit)


def top_rows(df: DataFrame, within: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; no limit if n <= 0."""
    if n <= 0:
        return df
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def merge_serp(serp: DataFrame) -> DataFrame:
    """Rows of one query and canonical URL become one: scalars of the first, engines and lanes of all, first content and date that are there."""
    order = ["source_ordinal", "position"]
    rows = serp.withColumn("url_key", canonical_url(F.col("url"))).filter("url_key <> ''")
    at = F.struct(*order)
    filled = lambda c: F.min_by(F.when(F.coalesce(c, F.lit("")) != "", c), F.when(F.coalesce(c, F.lit("")) != "", at))
    engines = F.col("source_engines") if "source_engines" in serp.columns else F.array().cast("array<string>")
    seen = F.filter(F.concat(F.coalesce(engines, F.array().cast("array<string>")), F.array("engine")), lambda e: F.coalesce(e, F.lit("")) != "")
    merged = rows.groupBy(*KEY, "url_key").agg(
        F.min(at).alias("first"), F.min_by("url", at).alias("url"), F.min_by("title", at).alias("title"), F.min_by("engine", at).alias("engine"),
        filled(F.col("content")).alias("content"), filled(F.col("published_date")).alias("published_date"),
        F.array_distinct(F.flatten(ordered(seen, order))).alias("source_engines"), F.array_distinct(ordered(F.col("search_lane"), order)).alias("search_lanes"),
    )
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("first"))).drop("first")


def search_merge(serp: DataFrame, n: int = C.RESULTS_PER_QUERY) -> DataFrame:
    """Merged results of all sources, the first n of each query."""
    return merge_serp(serp).filter(F.col("rank") <= n)


def serp_counts(serp: DataFrame) -> DataFrame:
    """Raw and merged result counts of each research."""
    raw = serp.groupBy("research_id").agg(F.count("*").alias("raw_total"))
    merged = serp.select(*KEY, canonical_url(F.col("url")).alias("k")).filter("k <> ''").distinct().groupBy("research_id").agg(F.count("*").alias("total"))
    return raw.join(merged, "research_id", "left").select("research_id", "raw_total", F.coalesce("total", F.lit(0)).alias("total"))


def attach_provenance(pages: DataFrame, picks: DataFrame) -> DataFrame:
    """pages (research_id, url, title, ...) with from_query, group_index and result_index of the candidate (picks: research_id, url, title and these) of the same canonical URL, the last one picked; its title fills an empty one."""
    own = ["from_query", "group_index", "result_index"]
    keyed = picks.select("research_id", canonical_url(F.col("url")).alias("_k"), F.col("title").alias("_title"), *own).filter("_k <> ''")
    last = first_by(keyed, ["research_id", "_k"], [F.desc("group_index"), F.desc("result_index")])
    met = pages.withColumn("_k", canonical_url(F.col("url"))).join(last, ["research_id", "_k"], "left")
    return met.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), "_title", "title")).drop("_k", "_title")


def exclude_seen(cands: DataFrame, seen: DataFrame, key: Column | None = None) -> DataFrame:
    """Candidates whose key no seen URL of the same research has."""
    key = canonical_url(F.col("url")) if key is None else key
    return cands.withColumn("_k", key).join(seen.select("research_id", key.alias("_k")), ["research_id", "_k"], "left_anti").drop("_k")


def resolve_picks(serp: DataFrame, picks: DataFrame, most: int) -> DataFrame:
    """Result rows of picks (group_index = query_ordinal, result_index = rank - 1); unknown indices vanish, a group has ``most``, a URL is taken once."""
    rows = serp.select("research_id", F.col("query_ordinal").alias("group_index"), (F.col("rank") - 1).alias("result_index"), "url", "url_key", "title")
    found = picks.select("research_id", "group_index", "pick_ordinal", "result_index").join(rows, ["research_id", "group_index", "result_index"])
    return first_by(top_rows(found, ["research_id", "group_index"], ["pick_ordinal"], most), ["research_id", "url_key"], ["group_index", "pick_ordinal"])


def top_up_picks(serp: DataFrame, picks: DataFrame, least: int, most: int) -> DataFrame:
    """Picks without repeats and at most ``most`` a group, filled up with the lowest results to ``least`` where there are so many."""
    group = ["research_id", "query_ordinal"]
    size = serp.groupBy(*group).agg(F.max("rank").alias("n"))
    valid = picks.withColumnRenamed("group_index", "query_ordinal").join(size, group).filter("result_index >= 0 and result_index < n").drop("n")
    kept = top_rows(first_by(valid, [*group, "result_index"], ["pick_ordinal"]), group, ["pick_ordinal"], most).select(*group, "result_index", "pick_ordinal", F.lit("picked").alias("reason"))
    have = kept.groupBy(*group).agg(F.count("*").alias("have"))
    rest = serp.select(*group, (F.col("rank") - 1).alias("result_index")).join(kept, [*group, "result_index"], "left_anti").join(have, group, "left")
    rest = rest.withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy("result_index"))).filter(F.col("i") <= min(least, most) - F.coalesce("have", F.lit(0)))
    return kept.unionByName(rest.select(*group, "result_index", (F.col("i") + 1_000_000).alias("pick_ordinal"), F.lit("coverage fallback").alias("reason"))).drop("pick_ordinal")


def carryover(serp: DataFrame, seen: DataFrame, queries: DataFrame, label: str, cap: int = 0) -> DataFrame:
    """Results of earlier groups that were not read, as further groups named after their query; empty groups vanish."""
    left = top_rows(exclude_seen(serp, seen), KEY, ["rank"], cap)
    named = left.join(queries, KEY).withColumn("label", F.concat(F.lit(f"{label}: "), "query"))
    return named.withColumn("group_index", F.dense_rank().over(Window.partitionBy("research_id").orderBy("query_ordinal")) - 1)


def u_order(pages: DataFrame, importance: str, page_order: str) -> DataFrame:
    """Most important pages first and last: even ranks fill from the front, odd ones from the back. Up to two pages, and pages of which none has an importance, keep their order."""
    w = Window.partitionBy("research_id")
    ranked = pages.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy(F.col(importance).asc_nulls_last(), page_order)) - 1, "own": F.row_number().over(w.orderBy(page_order)) - 1, "any": F.count(importance).over(w)})
    at = F.when(F.col("i") % 2 == 0, F.floor(F.col("i") / 2)).otherwise(F.col("n") - 1 - F.floor((F.col("i") - 1) / 2))
    return ranked.withColumn("slot", F.when((F.col("n") <= 2) | (F.col("any") == 0), F.col("own")).otherwise(at).cast("long")).drop("n", "i", "own", "any")


def _streamed(rows: DataFrame, group: list[str], order: list[str], start: Callable[[dict], object], schema: str) -> DataFrame:
    """What ``start(first row)`` gives of each group: it sees the group's rows one by one in order, and its ``end()`` gives the rows of the result. Groups come one after the other, so a task holds one of these at a time, not the group."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, None
        for frame in frames:
            out = []
            for x in frame.to_dict("records"):
                if (key := tuple(None if pd.isna(x[c]) else x[c] for c in group)) != now:
                    out += at.end() if at else []
                    now, at = key, start(x)
                at.see(x)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(at.end() if at else [], columns=names)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


class _Budget:
    """Three passes over the candidates of a round, made while they go by.

    The first is decided at once, as it looks back alone. For the others a bounded number of candidates is kept: what both could
    take if the first had taken none of it, and as many more as it may have taken. A candidate that finds no place here could
    not be taken; nor could one with its URL that comes later.
    """

    def __init__(self, first: dict, least: int, target: int, most: int):
        self.floor, self.middle, self.ceiling = (max(0, n - int(first["spent"])) for n in (least, target, most))
        self.spare = self.ceiling + C.GROUP_COVERAGE
        self.n, self.cover, self.covered, self.kept, self.of_domain = 0, [], set(), {}, {}

    def see(self, x: dict) -> None:
        self.n += 1
        url, domain, group = x["url_key"], x["domain"], x["group_index"]
        if not url:
            return
        if len(self.cover) < C.GROUP_COVERAGE and pd.notna(group) and group not in self.covered and all(c["url_key"] != url for c in self.cover):
            self.cover.append(x)
            self.covered.add(group)
        if url in self.kept:
            return
        had = self.of_domain.get(domain, 0)
        open_ = had < self.spare if not domain else had < C.DOMAIN_CAP + C.GROUP_COVERAGE and (had or len(self.of_domain) <= self.spare)
        if open_ or len(self.kept) < 2 * self.spare:
            self.kept[url] = x
            if open_:
                self.of_domain[domain] = had + 1

    def end(self) -> list[dict]:
        wanted = min(self.n, self.ceiling)
        if self.n >= self.floor:
            wanted = min(wanted, max(self.floor, self.middle))
        out, urls, per_domain = [], set(), {}

        def take(x: dict, why: str) -> None:
            urls.add(x["url_key"])
            per_domain[x["domain"]] = per_domain.get(x["domain"], 0) + bool(x["domain"])
            out.append({**x, "slot": len(out), "pass": why})

        for x in self.cover[:wanted]:
            take(x, "coverage")
        for why, cap in (("domain", C.DOMAIN_CAP), ("fill", None)):
            for url, x in self.kept.items():
                if len(out) < wanted and url not in urls and (cap is None or per_domain.get(x["domain"], 0) < cap):
                    take(x, why)
        return out


def allocate_budget(cands: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """Crawl list of each (research_id, round) from candidates in ``ordinal`` order.

    One of each query group first, then in order with at most DOMAIN_CAP of a domain, then in order.
    A column ``spent`` in cands is what the research has used of this budget already.
    """
    spent = F.coalesce("spent", F.lit(0)).cast("long") if "spent" in cands.columns else F.lit(0).cast("long")
    keyed = cands.select(spent.alias("spent"), "research_id", "round", "ordinal", "group_index", "url", canonical_url(F.col("url")).alias("url_key"), url_domain(F.col("url")).alias("domain"))
    schema = f"{', '.join(f'{n} {t}' for n, t in keyed.dtypes)}, slot long, pass string"
    return _streamed(keyed, ["research_id", "round"], ["ordinal"], lambda x: _Budget(x, least, target, most), schema).drop("spent")


class _Quota:
    """Results of a query under both quotas while they go by, and those to try again: as many of a domain as its quota, and as the limit may leave places for and lose again."""

    def __init__(self, limit: int, engine_quota: int, domain_quota: int | None):
        self.limit, self.engine_quota, self.domain_quota = limit, engine_quota, domain_quota
        self.out, self.later, self.engines, self.domains, self.waiting = [], [], {}, {}, {}

    def free(self, x: dict) -> bool:
        return not (self.domain_quota and x["_domain"] and self.domains.get(x["_domain"], 0) >= self.domain_quota)

    def take(self, x: dict) -> None:
        self.engines[x["_engine"]] = self.engines.get(x["_engine"], 0) + 1
        self.domains[x["_domain"]] = self.domains.get(x["_domain"], 0) + 1
        self.out.append({**x, "slot": len(self.out)})

    def see(self, x: dict) -> None:
        if len(self.out) >= self.limit or not self.free(x):
            return
        if self.engines.get(x["_engine"], 0) < self.engine_quota:
            self.take(x)
            return
        n = self.waiting.get(x["_domain"], 0)
        if len(self.later) < 2 * self.limit and not (self.domain_quota and x["_domain"] and n >= self.domain_quota):
            self.waiting[x["_domain"]] = n + 1
            self.later.append(x)

    def end(self) -> list[dict]:
        for x in self.later:
            if len(self.out) < self.limit and self.free(x):
                self.take(x)
        return self.out


def diversity_quota(results: DataFrame, limit: int, engine_quota: int | None, domain_quota: int | None) -> DataFrame:
    """At most so many results of an engine and of a domain in each query; what the engine quota refused is tried again under the domain quota alone."""
    keyed = results.withColumns({"_engine": F.lower(F.trim(F.coalesce(F.nullif(F.col("engine"), F.lit("")), F.lit("unknown")))), "_domain": url_domain(F.col("url"))})
    if not engine_quota:
        if domain_quota:
            n = F.row_number().over(Window.partitionBy(*KEY, "_domain").orderBy("rank"))
            keyed = keyed.withColumn("_n", n).filter((F.col("_domain") == "") | (F.col("_n") <= domain_quota)).drop("_n")
        return top_rows(keyed, KEY, ["rank"], limit).withColumn("slot", F.row_number().over(Window.partitionBy(*KEY).orderBy("rank")) - 1).drop("_engine", "_domain")
    kinds = ", ".join(f"{n} {t}" for n, t in keyed.dtypes)
    return _streamed(keyed, KEY, ["rank"], lambda _: _Quota(limit, engine_quota, domain_quota), f"{kinds}, slot long").drop("_engine", "_domain")


class _Spread:
    """The sources of a research, a handful of rows, with the quotas that they have after all rounds."""

    def __init__(self, first: dict):
        self.left, self.rows = max(0, int(first["total"])), []

    def see(self, x: dict) -> None:
        self.rows.append(x)

    def end(self) -> list[dict]:
        while self.left > 0 and (open_ := [x for x in self.rows if x["per_query"] < x["cap"]]):
            share, more = divmod(self.left, len(open_))
            for i, x in enumerate(open_):
                given = min(share + (i < more), x["cap"] - x["per_query"])
                x["per_query"] += given
                self.left -= given
        return self.rows


def redistribute_quota(sources: DataFrame, total: Column) -> DataFrame:
    """Quotas of each research's sources (ordinal, api, per_query) after spreading ``total`` evenly over those below their cap, rounds until spent."""
    cap = F.coalesce(F.create_map(*(F.lit(x) for p in C.PROVIDER_CAPS.items() for x in p))[F.col("api")], F.lit(100))
    rows = sources.select("research_id", "ordinal", "api", F.col("per_query").cast("long").alias("per_query"), cap.cast("long").alias("cap"), total.cast("long").alias("total"))

    return _streamed(rows, ["research_id"], ["ordinal"], _Spread, "research_id long, ordinal long, api string, per_query long, cap long")


def site_queries(queries: DataFrame, n: int = C.MOST_SITE_QUERIES) -> DataFrame:
    """Queries of each research restricted to groups of sites, distinct, the first n."""
    clauses = F.array(*(F.lit("(" + " OR ".join(f"site:{s}" for s in g) + ")") for g in C.SITE_GROUPS))
    each = queries.withColumn("q", F.trim(F.coalesce("query", F.lit("")))).filter("q <> ''").select("research_id", "query_ordinal", "q", F.posexplode(clauses).alias("site_ordinal", "clause"))
    built = first_by(each.withColumn("site_query", F.concat_ws(" ", "q", "clause")), ["research_id", "site_query"], ["query_ordinal", "site_ordinal"])
    return top_rows(built, ["research_id"], ["query_ordinal", "site_ordinal"], n).select("research_id", "query_ordinal", "site_ordinal", "site_query")


def next_queries(reviews: DataFrame, most: int) -> DataFrame:
    """Reviewer's queries, then the default ones, distinct, at most ``most``."""
    return reviews.select("research_id", F.slice(F.array_distinct(F.filter(F.transform(F.concat(F.coalesce("next_search_queries", F.array().cast("array<string>")), "default_queries"), lambda x: F.trim(x)), lambda q: q != "")), 1, most).alias("queries"))


def missing_focus(reviews: DataFrame) -> DataFrame:
    """Up to six points that are missing, or else the gap analysis."""
    missing = F.slice(F.filter(F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, 6)
    gap = F.trim(F.coalesce("gap_analysis", F.lit("")))
    return reviews.select("research_id", F.when(F.size(missing) > 0, missing).when(gap != "", F.array(gap)).otherwise(F.array().cast("array<string>")).alias("focus"))
