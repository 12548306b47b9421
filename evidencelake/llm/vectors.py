"""Vectors of whole-number components, and a stated query set met with all of them in cells.

A cell is a lane of vectors and a group of at most ``GROUP`` queries. Every vector is sent once for
each group and every query once for each lane, so a task holds one group of queries and streams the
vectors of its cell past them: memory does not grow with the tables, and no key is hot, as lanes are
dealt by row number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Queries that a task holds at once.
GROUP = 8192
#: A lane has at least so many vectors, if there are as many.
LANE = 4096
#: Scores that are made at once.
TILE = 1 << 20
#: Whole numbers up to here are exact as floats.
EXACT = 1 << 53
#: Scores beyond this, up or down, count as this.
MOST = 1 << 61


def matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the components, as floats; short vectors are filled up with zeros."""
    with np.errstate(over="ignore"):
        x = np.nan_to_num(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale))
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(x) == len(n) * dims and (n == dims).all():
        return x.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = x
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: as floats where these can't round, else as longs that end at MOST."""
    top_a, top_b = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    if top_a * top_b * a.shape[1] < EXACT:
        return a @ b.T
    out = np.empty((len(a), len(b)), np.int64)
    wide = np.abs(b).max(1, initial=0) * top_a * a.shape[1] >= EXACT
    out[:, ~wide] = scores(a, b[~wide]) if wide.any() and not wide.all() else 0
    if wide.any():
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
        out[:, wide] = np.clip(whole(a).dot(whole(b[wide]).T), -MOST, MOST).astype(np.int64)
    return out


def _clean(scale: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            fit = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(x)], minlength=len(n)) == 0)
            with np.errstate(all="ignore"):
                norm = np.sqrt(np.bincount(row, np.floor(x * scale) ** 2, minlength=len(n)))
            out = pa.record_batch({c: b.column(c) for c in names} | {"norm": pa.array(norm, pa.float64()), "size": pa.array(n, pa.int64())})
            yield out.filter(pa.array(fit))

    return run


def clean(df: DataFrame, scale: int, tag: str) -> DataFrame:
    """A written table of the rows of ``df`` (v, and other columns) whose vectors take part, with norm (of floor(scale * x)), size and a row number of their own.

    Vectors that are null or hold null, NaN or infinite components are left out.
    """
    kind = df.schema["v"].dataType.simpleString()
    df = df if kind in ("array<float>", "array<double>") else df.withColumn("v", F.col("v").cast("array<double>"))
    ddl = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", norm double, size long"
    return materialize(df.mapInArrow(_clean(scale, df.columns), ddl).withColumn("row", F.monotonically_increasing_id()), tag)


def in_cells(asks: DataFrame, held: DataFrame, n_asks: int, n_held: int, group: int = GROUP) -> DataFrame:
    """asks and held in one frame, dealt by cell; in a cell the queries (kind 0) come before the vectors (kind 1).

    asks and held need a column row; columns that one of them lacks are null there.
    """
    groups = max(1, -(-n_asks // group))
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, min(4 * parts // groups + 1, -(-n_held // LANE)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asks.withColumn("g", dealt(groups)).withColumn("lane", every(lanes)).withColumn("kind", F.lit(0))
    c = held.withColumn("lane", dealt(lanes)).withColumn("g", every(groups)).withColumn("kind", F.lit(1))
    both = q.unionByName(c, allowMissingColumns=True).withColumn("cell", F.col("lane") * groups + F.col("g")).drop("lane", "g")
    return both.repartition("cell").sortWithinPartitions("cell", "kind")


def by_cell(batches: Iterator[pa.RecordBatch], begin: Callable[[pa.Table], object], rows: Callable[[object], int]) -> Iterator[tuple[object, pa.RecordBatch | None]]:
    """For each cell: (state, part of its vectors) again and again, then (state, None). begin makes the state of the cell's queries; a part has rows(state) vectors at most."""
    cell, asks, state = None, [], None
    for b in batches:
        ids, kinds = b.column("cell").to_numpy(), b.column("kind").to_numpy()
        at = 0
        ends = np.flatnonzero(np.diff(ids) | np.diff(kinds)) + 1
        for end in [*ends, b.num_rows]:
            if end == at:
                continue
            if ids[at] != cell:
                if state is not None:
                    yield state, None
                cell, asks, state = ids[at], [], None
            if kinds[at] == 0:
                asks.append(b.slice(at, end - at))
            elif asks:
                if state is None:
                    state = begin(pa.Table.from_batches(asks).combine_chunks())
                for i in range(at, end, n := max(1, rows(state))):
                    yield state, b.slice(i, min(n, end - i))
            at = end
    if state is not None:
        yield state, None


def whole_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as longs for sorting, null last, and which of them are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), null


def divisible(c: Column, by: int) -> Column:
    return F.coalesce(F.pmod(c, F.lit(by)) == 0, F.lit(False))
