import random

from evidencelake.operators import selection as S
from pyspark.sql import functions as F


def test_budget_keeps_its_limits_and_covers_groups(spark):
    random.seed(1)
    rows = [(r, 1, i, random.randrange(4), f"https://d{random.randrange(5)}.com/{random.randrange(20)}") for r in range(6) for i in range(30)]
    cands = spark.createDataFrame(rows, "research_id long, round int, ordinal int, group_index int, url string")
    got = S.allocate_budget(cands, 6, 9, 11).collect()
    for r in range(6):
        mine = [x for x in got if x["research_id"] == r]
        assert len(mine) == 9 and len({x["url_key"] for x in mine}) == 9
        assert len({x["group_index"] for x in mine[:3]}) == 3
        assert sorted(x["slot"] for x in mine) == list(range(9))


def test_quota_is_spread_until_caps(spark):
    rows = [(1, 0, "searxng", 1, 25), (1, 1, "brave", 5, 25), (1, 2, "tavily", 19, 25), (1, 3, "exa", 0, 25)]
    got = S.redistribute_quota(spark.createDataFrame(rows, "research_id long, ordinal long, api string, per_query long, total long"), F.col("total")).orderBy("ordinal").collect()
    assert [r["per_query"] for r in got] == [1, 18, 20, 11]  # 9, 1 and 8 in the first round, 4 and 3 in the second


def test_u_order(spark):
    rows = [(1, i, i) for i in range(5)] + [(2, 0, 1), (2, 1, 0)]
    got = S.u_order(spark.createDataFrame(rows, "research_id long, page int, imp int"), "imp", "page").orderBy("research_id", "slot").collect()
    assert [r["page"] for r in got] == [0, 2, 4, 3, 1, 0, 1]


def test_merge_keeps_lanes_and_engines(spark):
    rows = [(1, 0, 0, 1, "https://a.com/x?utm_q=1", "T", "", "brave", None, "general"), (1, 0, 1, 1, "https://A.com/x", "U", "text", "exa", "2020", "academic"), (1, 0, 1, 2, "", "V", "t", "exa", None, "academic")]
    df = spark.createDataFrame(rows, "research_id long, query_ordinal long, source_ordinal int, position int, url string, title string, content string, engine string, published_date string, search_lane string")
    (got,) = S.merge_serp(df).collect()
    assert (got["title"], got["content"], got["published_date"], got["source_engines"], got["search_lanes"]) == ("T", "text", "2020", ["brave", "exa"], ["general", "academic"])
