"""Hard-negative mining by a BOND vertical scan.

A part of the vectors is turned into columns, one a dimension, with the least and greatest value of
each. For an anchor the columns are read in descending order of the anchor's own components: after
every few columns each candidate has a partial score, and the columns still unread add between the
sum of their least and the sum of their greatest contributions. Candidates that these bounds rule
out leave the bitmap of candidates; those that stay to the end have exact scores.

The scan runs twice. The first finds an anchor's positives: a candidate is out once its upper bound
is below the scores of as many rows as are wanted. The second looks into windows of scores, one for
each positive: a candidate is out once it can reach no window, or only windows in which enough
better rows are certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import EXACT, MOST, by_cell, clean, in_cells, matrix, scores, whole_ids

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Columns read between two looks at the bounds.
STEP = 16
#: What is unread is cut down once fewer than 1/CUT of the candidates are left.
CUT = 4
#: Vectors scanned at once, and anchors that a task holds.
PART, ANCHORS = 4096, 4096


class Columns:
    """A part of the vectors, dimension by dimension."""

    def __init__(self, rows: np.ndarray, row: np.ndarray, ids: np.ndarray, null: np.ndarray):
        self.cells = np.ascontiguousarray(rows.T)
        self.least, self.greatest = self.cells.min(1, initial=np.inf), self.cells.max(1, initial=-np.inf)
        self.row, self.ids, self.null = row, ids, null
        self.top = np.abs(rows).max(initial=0)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Dimensions in descending order of |a|, and what those from each place on add at least and at most."""
        order = np.argsort(-np.abs(a), kind="stable")
        ends = a[order] * np.stack([self.least[order], self.greatest[order]])
        least, most = np.zeros(len(a) + 1), np.zeros(len(a) + 1)
        np.cumsum(np.minimum(*ends)[::-1], out=least[-2::-1])
        np.cumsum(np.maximum(*ends)[::-1], out=most[-2::-1])
        return order, least, most

    def scan(self, a: np.ndarray, alive: np.ndarray, still) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``alive`` that ``still`` (lower and upper bounds to a mask) leaves to the end, and their scores.

        Whole columns are added up while many candidates are left; then what is unread is cut down to these.
        """
        if np.abs(a).max(initial=0) * self.top * max(1, len(a)) >= EXACT:  # sums of columns could round
            s = scores(a[None], np.ascontiguousarray(self.cells[:, alive].T))[0].astype(np.int64)
            keep = still(s, s)
            return alive[keep], s[keep]
        order, least, most = self.bounds(a)
        n, s, cut, unread = self.cells.shape[1], 0.0, 0, None
        for at in range(0, len(order), STEP):
            end = min(at + STEP, len(order))
            some = order[at:end]
            s = s + a[some] @ (self.cells[some] if unread is None else unread[at - cut : end - cut])
            seen = s[alive] if unread is None else s
            keep = still(seen + least[end], seen + most[end])
            alive = alive[keep]
            if unread is not None:
                s = s[keep]
                unread = unread[:, keep] if not keep.all() else unread
            elif end == len(order):
                s = seen[keep]
            elif len(alive) < n // CUT:
                s, cut, unread = seen[keep], end, self.cells[np.ix_(order[end:], alive)]
            if not len(alive):
                return alive, np.array([], np.int64)
        return alive, s.astype(np.int64) if len(order) else np.zeros(len(alive), np.int64)


def _part(b: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, ...]:
    """Vectors, row numbers, ids, null ids and labels."""
    return matrix(b.column("v"), dims, scale), b.column("row").to_numpy(zero_copy_only=False), *whole_ids(b.column("vec_id")), b.column("label").to_numpy(zero_copy_only=False)


def _order(s: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.lexsort((row, ids, -s))


class _Best:
    """The n best (score, id, row) seen so far."""

    def __init__(self, n: int):
        self.n, self.s, self.ids, self.row, self.null = n, *(np.array([], np.int64) for _ in range(3)), np.array([], bool)

    def least(self) -> int:
        return self.s[-1] if len(self.s) == self.n else -MOST - 1

    def add(self, part: Columns, at: np.ndarray, s: np.ndarray) -> None:
        if len(s) > 8 * self.n:
            few = np.flatnonzero(s >= np.partition(s, len(s) - self.n)[len(s) - self.n])
            at, s = at[few], s[few]
        s, ids, row, null = (np.concatenate(x) for x in ((self.s, s), (self.ids, part.ids[at]), (self.row, part.row[at]), (self.null, part.null[at])))
        best = _order(s, ids, row)[: self.n]
        self.s, self.ids, self.row, self.null = s[best], ids[best], row[best], null[best]


def _nth(x: np.ndarray, n: int, floor: int) -> float:
    """The n-th greatest, or floor if that is more or there are fewer."""
    return max(floor, np.partition(x, len(x) - n)[len(x) - n]) if len(x) >= n else floor


class _Anchors:
    def __init__(self, t: pa.Table, dims: int, scale: int, n: int, windows: bool):
        get = lambda c: t.column(c).combine_chunks()
        self.a = matrix(get("v"), dims, scale)
        self.row, self.label = get("row").to_numpy(zero_copy_only=False), get("label").to_numpy(zero_copy_only=False)
        self.scores = get("scores").to_pylist() if windows else [[None]] * len(self.row)
        self.best = [[_Best(n) for _ in s] for s in self.scores]


def _flat(anchors: _Anchors) -> pa.RecordBatch:
    out = [(r, p, b) for r, ps, bs in zip(anchors.row.tolist(), anchors.scores, anchors.best) for p, b in zip(ps, bs)]
    n = [len(b.s) for *_, b in out]
    join = lambda name: np.concatenate([np.array([], np.int64), *(getattr(b, name) for *_, b in out)])
    spread = lambda xs: pa.array([x for x, k in zip(xs, n) for _ in range(k)], pa.int64())
    return pa.record_batch({"row": spread([r for r, *_ in out]), "positive_score": spread([p for _, p, _ in out]), "vec_id": pa.array(join("ids"), mask=join("null").astype(bool)), "at": pa.array(join("row")), "score": pa.array(join("s"))})


def _positives(dims: int, scale: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, b in by_cell(batches, lambda t: _Anchors(t, dims, scale, n, False), lambda _: PART):
            if b is None:
                yield _flat(anchors)
                continue
            *of, labels = _part(b, dims, scale)
            same = {label: Columns(*(x[labels == label] for x in of)) for label in np.intersect1d(labels, anchors.label)}
            for a, row, label, (best,) in zip(anchors.a, anchors.row, anchors.label, anchors.best):
                part = same.get(label)
                if part is None:
                    continue
                alive = np.flatnonzero(part.row != row)
                if len(alive):
                    at, s = part.scan(a, alive, lambda low, high, best=best: high >= _nth(low, n, best.least()))
                    best.add(part, at, s)

    return run


def _negatives(dims: int, scale: int, n: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchors, b in by_cell(batches, lambda t: _Anchors(t, dims, scale, n, True), lambda _: PART):
            if b is None:
                yield _flat(anchors)
                continue
            *of, labels = _part(b, dims, scale)
            part = Columns(*of)
            other = {label: np.flatnonzero(labels != label) for label in np.unique(anchors.label)}
            for a, label, positive, bests in zip(anchors.a, anchors.label, anchors.scores, anchors.best):
                windows = [(-(-low * p // 100), high * p // 100, x) for p, x in zip(positive, bests) if low * p <= high * p]
                if not windows or not len(other[label]):
                    continue
                floor, top = min(w[0] for w in windows), max(w[1] for w in windows)

                def still(least: np.ndarray, most: np.ndarray, windows=windows, floor=floor, top=top) -> np.ndarray:
                    out = (most >= floor) & (least <= top)
                    near = np.flatnonzero(out)
                    lo, hi = least[near], most[near]
                    fit = np.zeros(len(near), bool)
                    for w_lo, w_hi, x in windows:
                        sure = lo[(lo >= w_lo) & (hi <= w_hi)]
                        fit |= (lo <= w_hi) & (hi >= max(w_lo, _nth(sure, n, x.least())))
                    out[near] = fit
                    return out

                at, s = part.scan(a, other[label], still)
                for w_lo, w_hi, x in windows:
                    hit = (s >= w_lo) & (s <= w_hi)
                    if hit.any():
                        x.add(part, at[hit], s[hit])

    return run


FOUND = "row long, positive_score long, vec_id long, at long, score long"


def hard_negatives(vectors: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of ``vectors`` (vec_id, embedding, label), the rows where ``asks`` holds.

    An anchor's positives are its best other rows of its label; for each, the best rows of other labels follow whose score is
    between low and high hundredths of the positive's, both included. A score is the inner product of floor(scale * x) of the
    components, exact, within +-2**61; ties go to the smaller vec_id, null last. Rows with a null label or vector, or with null or
    non-finite components, take no part, neither as anchors. Shorter vectors count as filled up with zeros. Rows that repeat a
    vec_id are rows of their own. A positive without a fitting negative gives no row, nor does an empty table. Other columns are
    read by ``asks`` alone.
    """
    spark = vectors.sparkSession
    base = vectors.filter("label is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = clean(base, scale, "vectors")
    n, n_asks, dims = rows.agg(F.count("*"), F.count_if("asks"), F.max("size")).first()
    if not n_asks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held, anchors = rows.select("row", "vec_id", "v", "label"), rows.filter("asks").select("row", "vec_id", "v", "label")
    best = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "at")
    near = in_cells(anchors, held, n_asks, n, group).mapInArrow(_positives(dims, scale, positives), FOUND)
    near = near.withColumn("i", F.row_number().over(best("row"))).filter(F.col("i") <= positives)
    near = materialize(near.select("row", F.col("vec_id").alias("positive_id"), "i", F.col("score").alias("positive_score")), "positives")
    asked = anchors.join(near.groupBy("row").agg(F.collect_set("positive_score").alias("scores")), "row")
    far = in_cells(asked, held, n_asks, n, group).mapInArrow(_negatives(dims, scale, negatives, low, high), FOUND)
    far = far.withColumn("rank", F.row_number().over(best("row", "positive_score"))).filter(F.col("rank") <= negatives)
    pairs = near.join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    found = far.select("row", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
