"""Exact top-k and hard negatives against plain loops over all pairs of whole numbers."""

import math
import random

import numpy as np
import pytest
from evidencelake.llm import hard_negatives, topk, vectors
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, norm string, asks int, cell string, kind string, score int"


def table(spark, rows):
    """Vectors with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(*r, "r", 1, "n", 2, "c", "k", 3) for r in rows], SCHEMA).repartition(3)


def cells(x, scale):
    if x is None or any(y is None or not math.isfinite(y) for y in x):
        return None
    return [math.floor(scale * float(np.float32(y))) for y in x]


def dot(a, b):
    return max(-vectors.MOST, min(vectors.MOST, sum(x * y for x, y in zip(a, b))))


def ordered(found):
    return sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def brute_top(rows, by, k, scale):
    live = [(i, r[0], c) for i, r in enumerate(rows) if (c := cells(r[1], scale)) is not None]
    out = []
    for i, q, a in live:
        if q is not None and q % by == 0:
            best = ordered([(v, dot(a, b)) for j, v, b in live if j != i])[:k]
            out += [(q, n + 1, v, s) for n, (v, s) in enumerate(best)]
    return sorted(out, key=repr)


def brute_negatives(rows, by, positives, negatives, low, high, scale):
    live = [(i, r[0], c, r[2]) for i, r in enumerate(rows) if (c := cells(r[1], scale)) is not None and r[2] is not None]
    out = []
    for i, q, a, label in live:
        if q is None or q % by:
            continue
        near = ordered([(v, dot(a, b)) for j, v, b, x in live if j != i and x == label])[:positives]
        far = ordered([(v, dot(a, b)) for j, v, b, x in live if x != label])
        for p, s in near:
            fit = [(v, t) for v, t in far if low * s <= 100 * t <= high * s][:negatives]
            out += [(q, p, n + 1, v, s, t) for n, (v, t) in enumerate(fit)]
    return sorted(out, key=repr)


def some_rows(n=260, dims=8, seed=3):
    rng = random.Random(seed)
    one = lambda d=dims: [rng.uniform(-0.7, 0.7) for _ in range(d)]
    hot = one()
    rows = [(i, hot if i % 3 == 0 else one(), rng.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(10, one(), 1), (10, hot, 0), (None, one(), 1), (None, hot, 0), (20, None, 1), (30, [], 0), (40, [0.5, -0.25], 2), (50, [None] * dims, 1), (60, [float("nan")] + one()[1:], 1), (70, [float("inf")] + one()[1:], 0), (80, one(), None), (0, [0.0] * dims, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [8192, 7])
def test_top_k_equals_all_pairs(spark, group):
    rows = some_rows()
    got = topk.exact_top_k(table(spark, rows), vectors.divisible(F.col("vec_id"), 10), k=6, group=group)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(rows, 10, 6, 1024)


@pytest.mark.parametrize("group", [4096, 5])
def test_negatives_equal_all_pairs(spark, group):
    rows = some_rows(seed=5)
    got = hard_negatives.hard_negatives(table(spark, rows), vectors.divisible(F.col("vec_id"), 10), group=group)
    want = brute_negatives(rows, 10, 5, 3, 50, 95, 256)
    assert want and sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_components_too_large_for_floats(spark):
    rows = [(i, [math.sin(i) * 10.0 ** (i % 9), math.cos(i), 3.0, 0.1], i % 2) for i in range(60)] + [(60, [1e30, -1e30, 1.0, 2.0], 0), (61, [3e38] * 4, 1)]
    got = topk.exact_top_k(table(spark, rows), vectors.divisible(F.col("vec_id"), 10), k=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(rows, 10, 4, 1024)
    got = hard_negatives.hard_negatives(table(spark, rows), vectors.divisible(F.col("vec_id"), 10))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows, 10, 5, 3, 50, 95, 256)


def test_fewer_rows_than_wanted_and_none(spark):
    rows = [(0, [0.1, 0.2], 0), (1, [0.2, 0.1], 0), (2, [0.3, 0.3], 1)]
    asks = vectors.divisible(F.col("vec_id"), 10)
    assert sorted(map(tuple, topk.exact_top_k(table(spark, rows), asks).collect())) == brute_top(rows, 10, 10, 1024)
    for few in ([], rows[:1], [(1, [0.5], 0), (2, [0.5], 1)]):
        assert topk.exact_top_k(table(spark, few), asks).collect() == []
        assert hard_negatives.hard_negatives(table(spark, few), asks).collect() == []


def test_every_vector_alike(spark):
    rows = [(i, [0.25, -0.5, 0.125], 0) for i in range(700)]
    got = topk.exact_top_k(table(spark, rows), vectors.divisible(F.col("vec_id"), 100), k=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_top(rows, 100, 10, 1024)


def test_vertical_scan_keeps_what_bounds_cannot_rule_out():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 60, (500, 40)))
    columns = hard_negatives.Columns(x, np.arange(500), np.arange(500), np.zeros(500, bool))
    truth = (x @ x[3]).astype(np.int64)
    seen = []

    def still(low, high):
        seen.append(len(low))
        return high >= 60_000

    at, s = columns.scan(x[3], np.arange(500), still)
    assert (truth[at] == s).all() and set(np.flatnonzero(truth >= 60_000)) <= set(at.tolist())
    assert seen[0] == 500 and seen[-1] < 500
