"""Greedy passes with bounded state against passes over whole groups."""

import random

import pandas as pd
import pytest
from evidencelake import config as C
from evidencelake.operators import selection as S
from pyspark.sql import functions as F


def budget(items, least, target, most):
    wanted = min(len(items), most)
    if len(items) >= least:
        wanted = min(wanted, max(least, target))
    out, urls, covered, domains = [], set(), set(), {}
    for why in ("coverage", "domain", "fill"):
        for x in items:
            fits = {"coverage": len(out) < min(wanted, C.GROUP_COVERAGE) and x["group_index"] not in covered, "domain": domains.get(x["domain"], 0) < C.DOMAIN_CAP, "fill": True}[why]
            if len(out) < wanted and fits and x["url_key"] not in urls:
                urls.add(x["url_key"])
                covered.add(x["group_index"])
                domains[x["domain"]] = domains.get(x["domain"], 0) + bool(x["domain"])
                out.append((x["url_key"], why))
    return out


def quota(items, limit, engine_quota, domain_quota):
    out, later, engines, domains = [], [], {}, {}
    for strict, some in ((True, items), (False, later)):
        for x in some:
            full = domain_quota and x["_domain"] and domains.get(x["_domain"], 0) >= domain_quota
            if len(out) < limit and not full and not (strict and engines.get(x["_engine"], 0) >= engine_quota):
                engines[x["_engine"]] = engines.get(x["_engine"], 0) + 1
                domains[x["_domain"]] = domains.get(x["_domain"], 0) + 1
                out.append(x["rank"])
            elif strict:
                later.append(x)
    return out


def test_budget_over_random_candidates():
    rng = random.Random(3)
    for _ in range(3000):
        n, k, m = rng.randint(1, 60), rng.randint(1, 8), rng.randint(1, 30)
        items = []
        for i in range(n):
            domain = rng.choice(["", *map(str, range(k))])
            items.append({"group_index": rng.randint(0, rng.choice([1, 3, 20])), "domain": domain, "url_key": f"{domain}/{rng.randint(0, m)}", "spent": 0, "ordinal": i})
        limits = rng.choice([(6, 9, 11), (3, 4, 5), (2, 3, 4), (1, 1, 1), (0, 0, 2)])
        state = S._Budget(items[0], *limits)
        for x in items:
            state.see(x)
        assert [(x["url_key"], x["pass"]) for x in state.end()] == budget(items, *limits)


def test_quota_over_random_results():
    rng = random.Random(4)
    for _ in range(3000):
        items = [{"_engine": rng.choice("abc"[: rng.randint(1, 3)]), "_domain": rng.choice(["", *map(str, range(rng.choice([1, 3, 12])))]), "rank": i} for i in range(rng.randint(1, 80))]
        limit, engines, domains = rng.randint(1, 12), rng.randint(1, 4), rng.choice([None, 1, 2, 3])
        state = S._Quota(limit, engines, domains)
        for x in items:
            state.see(x)
        assert [x["rank"] for x in state.end()] == quota(items, limit, engines, domains)


def test_state_does_not_grow_with_the_session():
    state, most = S._Budget({"spent": 0}, 6, 9, 11), 0
    for i in range(200_000):
        state.see({"group_index": i % 5000, "domain": f"d{i % 9000}", "url_key": f"d{i % 9000}/{i}", "spent": 0, "ordinal": i})
        most = max(most, len(state.kept))
    assert most < 120 and len(state.end()) == 9
    other = S._Quota(30, 2, 3)
    for i in range(200_000):
        other.see({"_engine": "a", "_domain": f"d{i}", "rank": i})
    assert len(other.later) == 60 and len(other.end()) == 30


@pytest.mark.parametrize("sessions", [1, 40])
def test_budget_of_tables(spark, sessions):
    df = spark.range(20_000).select((F.col("id") % sessions).alias("research_id"), F.lit(1).alias("round"), F.col("id").alias("ordinal"), (F.col("id") % 7).cast("int").alias("group_index"), F.concat(F.lit("https://h"), F.col("id") % 97, F.lit(".org/"), F.col("id") % 5003).alias("url")).repartition(5)
    got = S.allocate_budget(df, 6, 9, 11).toPandas()
    assert set(got.groupby("research_id").size()) == {9} and set(got["pass"]) <= {"coverage", "domain", "fill"}
    want = budget(pd.DataFrame([{"group_index": i % 7, "domain": f"h{i % 97}.org", "url_key": f"https://h{i % 97}.org/{i % 5003}"} for i in range(0, 20_000, sessions)]).to_dict("records"), 6, 9, 11)
    assert list(got[got["research_id"] == 0].sort_values("slot")["url_key"]) == [u for u, _ in want]
    assert S.allocate_budget(df.filter("id < 0") if "id" in df.columns else df.limit(0), 6, 9, 11).count() == 0
