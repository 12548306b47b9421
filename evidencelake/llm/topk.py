"""Exact top-k search by distributed histogram selection.

Every pass scores all vectors against all queries that are still open and adds up one histogram of
scores a query over the range that holds its k-th value; the next pass looks at the bin that holds
it, in finer bins, until a bin has just the rows that are needed or is one score wide. Then all rows
at or above the value are given, and ties at it go to the smaller id.

A task that has itself seen as many rows as a query needs counts nothing below them, since the k-th
value can't lie there. So what is shuffled are a few bins of each query and task, never scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import GROUP, MOST, TILE, by_cell, clean, in_cells, matrix, scores, whole_ids

K, SCALE = 10, 1024
BINS = 512


def _column(t, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


class _Asks:
    """The queries of a cell, sorted by row."""

    def __init__(self, t: pa.Table, dims: int, scale: int):
        order = np.argsort(_column(t, "row"), kind="stable")
        self.row, self.lo, self.span, self.width, self.need = (_column(t, n)[order] for n in ("row", "lo", "span", "width", "need"))
        self.a = matrix(t.column("v").combine_chunks(), dims, scale)[order]
        self.floor = self.lo.copy()  # below it nothing counts
        self.bins: dict[int, np.ndarray] = {}
        self.kept: list[tuple] = []

    def own(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs of a query with its own row."""
        at = np.minimum(np.searchsorted(self.row, row), len(self.row) - 1)
        hit = np.flatnonzero(self.row[at] == row)
        return at[hit], hit

    def above(self, b: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and score of the pairs at or above the queries' floors."""
        s = scores(self.a, matrix(b.column("v"), dims, scale))
        fit = s >= self.floor[:, None]
        fit[self.own(_column(b, "row"))] = False
        q, c = np.nonzero(fit)
        return q, c, s[q, c].astype(np.int64)


def _count(dims: int, scale: int):
    """row, bin and count of each query and task; bins are numbered from the top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, b in by_cell(batches, lambda t: _Asks(t, dims, scale), lambda x: TILE // len(x.row)):
            if b is None:
                q = np.array(list(asks.bins), np.int64)
                n = np.array(list(asks.bins.values())).reshape(-1, BINS)
                at, bin_ = np.nonzero(n)
                yield pa.record_batch({"row": asks.row[q[at]] if len(q) else pa.array([], pa.int64()), "bin": pa.array(bin_.astype(np.int32)), "n": pa.array(n[at, bin_].astype(np.int64))})
                continue
            q, _, s = asks.above(b, dims, scale)
            inside = s - asks.lo[q] < asks.span[q]  # rows above the range are counted already
            q, s = q[inside], s[inside]
            bin_ = BINS - 1 - (s - asks.lo[q]) // asks.width[q]
            for i, start, end in zip(*(x.tolist() for x in _runs(q))):
                held = asks.bins.get(i)
                held = asks.bins[i] = np.zeros(BINS, np.int64) if held is None else held
                np.add.at(held, bin_[start:end], 1)
                full = int(np.searchsorted(np.cumsum(held), asks.need[i]))
                if full < BINS:
                    held[full + 1 :] = 0
                    asks.floor[i] = asks.lo[i] + (BINS - 1 - full) * asks.width[i]

    return run


def _runs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of an array."""
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], np.int64)
    return q[start], start, np.r_[start[1:], len(q)] if len(q) else start


def in_run(q: np.ndarray) -> np.ndarray:
    """Position of each element in its run."""
    _, start, end = _runs(q)
    return np.arange(len(q)) - np.repeat(start, end - start)


def _pick(dims: int, scale: int):
    """Rows above each query's value, and of those at it the smallest ids, as many as are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks, b in by_cell(batches, lambda t: _Asks(t, dims, scale), lambda x: TILE // len(x.row)):
            if b is None:
                continue
            q, c, s = asks.above(b, dims, scale)
            ids, null = whole_ids(b.column("vec_id"))
            row = _column(b, "row")
            tied = s == asks.lo[q]
            order = np.lexsort((row[c], ids[c], q, tied))
            q, c, s, tied = q[order], c[order], s[order], tied[order]
            keep = ~tied | (in_run(q * 2 + tied) < asks.need[q])
            q, c, s = q[keep], c[keep], s[keep]
            yield pa.record_batch({"row": pa.array(asks.row[q]), "vec_id": pa.array(ids[c], mask=null[c]), "at": pa.array(row[c]), "score": pa.array(s)})

    return run


def exact_top_k(vectors: DataFrame, asks: Column, k: int = K, scale: int = SCALE, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row of ``vectors`` (vec_id, embedding) where ``asks`` holds.

    Components become floor(scale * x); the score is their inner product, exact, within +-2**61. Ties go to the smaller
    vec_id, null last. Null vectors and those with null or non-finite components take no part; shorter vectors count as filled up
    with zeros. Rows that repeat a vec_id are rows of their own, as queries too. Where there are fewer than k other rows, all are
    given; an empty table, or no queries, gives no rows. Columns other than vec_id and embedding are read by ``asks`` alone.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = clean(base, scale, "vectors")
    n, n_asks, dims, norm = rows.agg(F.count("*"), F.count_if("asks"), F.max("size"), F.max("norm")).first()
    k = min(k, n - 1)
    held = rows.select("row", "vec_id", "v")
    if k < 1 or not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = F.least(F.col("norm") * norm * (1 + 1e-9) + 2, F.lit(float(MOST))).cast("long")
    width = F.expr(f"(span + {BINS - 1}) div {BINS}")
    start = rows.filter("asks").select("row", "vec_id", "v", (-most).alias("lo"), (2 * most + 1).alias("span"), F.lit(k).alias("need")).withColumn("width", width)
    opened = materialize(start, "topk")
    found, n_open = None, n_asks
    while n_open:
        counted = in_cells(opened, held, n_open, n, group).mapInArrow(_count(dims, scale), "row long, bin int, n long")
        bins = counted.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("row").orderBy("bin")))
        hit = opened.join(upto, "row").filter("upto >= need and upto - n < need")
        lo = F.col("lo") + (BINS - 1 - F.col("bin")) * F.col("width")
        rest = F.col("need") - (F.col("upto") - F.col("n"))
        over = (F.col("n") == rest) | (F.col("width") == 1)
        finer = hit.select("row", "vec_id", "v", lo.alias("lo"), F.col("width").alias("span"), rest.cast("int").alias("need"), over.alias("done"))
        done = materialize(finer.withColumn("width", width), "topk")
        discard(opened)
        found = done.filter("done") if found is None else found.unionByName(done.filter("done"))
        opened = materialize(done.filter("not done").drop("done"), "topk")
        n_open = opened.count()
    found = found.drop("done")
    names = found.select("row", F.col("vec_id").alias("query_id"))
    picked = in_cells(found, held, n_asks, n, group).mapInArrow(_pick(dims, scale), "row long, vec_id long, at long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    ranked = picked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(names, "row").select("query_id", "rank", "vec_id", "score")
