"""Work that goes by rows or streams of rows: results by plain rules, and plans without the shuffles or per-group calls that would cost more."""

import random

from evidencelake import config as C
from evidencelake.operators import pages as P
from evidencelake.operators import selection as S
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotas_are_spread_by_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(r, i, api, rng.randrange(8), total) for r in range(60) for total in [rng.choice((-1, 0, 1, 5, 40, 1000))] for i, api in enumerate(rng.sample(["searxng", "brave", "tavily", "exa", "other"], rng.randrange(1, 6)))]
    df = spark.createDataFrame(rows, "research_id long, ordinal int, api string, per_query int, total long").repartition(3)
    got = S.redistribute_quota(df, F.col("total"))
    want = set()
    for r in {x[0] for x in rows}:
        own = [[i, api, q, C.PROVIDER_CAPS.get(api, 100)] for k, i, api, q, _ in rows if k == r]
        left = max(0, next(x[4] for x in rows if x[0] == r))
        while left > 0 and (open_ := [x for x in own if x[2] < x[3]]):
            dealt = left
            for k, x in enumerate(open_):
                given = min(dealt // len(open_) + (k < dealt % len(open_)), x[3] - x[2])
                x[2], left = x[2] + given, left - given
        want |= {(r, *x) for x in own}
    assert {tuple(x) for x in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in plan(got)


def test_summaries_keep_four_best_blocks_in_order(spark):
    blocks = ["short", "A sentence of some length. " * 3, "# A heading that is long enough to count 12", "menu login about " * 5, "Numbers 123 456 ١٢٣ in a text。Two sentences！ And more of it.", "[a](b) [c](d) a line with links in it", "x" * 29, "Another sentence of some length? Yes." * 2]
    df = spark.createDataFrame([(1, " T ", "\n \n".join(blocks)), (2, "", " \n\n "), (3, "", None), (4, None, "one"), (5, "", "\n\n".join(reversed(blocks)))], "page_id long, title string, text string")
    made = P.summarize_pages(df)
    got = {r[0]: r[1:] for r in made.collect()}
    assert set(got) == {1, 4, 5} and got[4] == (1, "one")
    assert got[1] == (8, "# T\n\n" + "\n\n".join((blocks[1].strip(), blocks[2], blocks[4], blocks[7])))
    assert got[5] == (8, "\n\n".join((blocks[7], blocks[4], blocks[2], blocks[1].strip())))
    assert "Window" not in plan(made) and "Aggregate" not in plan(made)
