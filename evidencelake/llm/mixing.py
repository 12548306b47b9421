"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised; 1 keeps the shares, 0 makes sources
equal, more than 1 favours large ones. The exponent is bisected to the largest that reaches a target
entropy, and moved towards 1 where a source would be repeated more often than allowed. The weights are realised over a token budget as
block permutations: a source's documents fall into blocks by hash, every epoch takes the blocks in
an order of its own, and the last, partial epoch ends at the document with which the source's quota
would be exceeded. The cut is found from sums of blocks, then of the cells of one block, then among
the documents of one cell, so no task orders the documents of a source. Sources are rows of a table
throughout: each step of the bisection is an aggregate over them for ``GRID`` exponents at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Blocks of a source, and cells of a block.
BLOCKS = 256
SEED = 42
#: Tables of one row a source are broadcast up to so many sources; beyond, Spark chooses.
MOST_BROADCAST = 10_000
ENTROPY, MOST_REPEATS, BUDGET_SHARE = 0.97, 4.0, 1.0
#: Sources that are more even than the target are sharpened by an exponent up to this.
MOST_EXPONENT = 64.0
#: Exponents of one step of the bisection, and steps: the interval shrinks to 64 ** -9.
GRID, ROUNDS = 64, 9


def moments(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """Of ``sources`` (t: tokens of a source, share: of all) at each exponent: the norm of the raised shares, the entropy as a share of the most that so many sources can have, and the largest weight for a token."""
    live = sources.filter("t > 0").select("t", "share", F.explode(F.lit(exponents)).alias("a"))
    raised = F.pow("share", "a")
    found = live.groupBy("a").agg(F.count("*").alias("n"), F.sum(raised).alias("s"), F.sum(raised * F.log("share")).alias("l"), F.max(raised / F.col("t")).alias("most"))
    of = {r["a"]: r for r in found.collect()}
    entropy = lambda r, a: (math.log(r["s"]) - a * r["l"] / r["s"]) / math.log(r["n"]) if r["n"] > 1 else 1.0
    return [(of[a]["s"], entropy(of[a], a), of[a]["most"] / of[a]["s"]) if a in of else (1.0, 1.0, 0.0) for a in exponents]


def bisect_exponent(at: Callable[[list[float]], list[tuple[float, float, float]]], budget: float, target_entropy: float | None, most_repeats: float | None, most: float = 1.0) -> float:
    """The exponent in [0, most]: the largest whose entropy reaches the target, or the nearest to it, towards 1, that keeps the repetition limit.

    ``at`` gives moments at exponents. Without a target it is the least that keeps the limit, up to 1; where
    no exponent reaches the target or even 1 does not keep the limit, it is 0 or 1.
    """

    def least(holds, low: float = 0.0, high: float = 1.0) -> float:
        """Least exponent from which on the monotone condition holds; the highest if nowhere."""
        none = high
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            first = next((k for k, x in enumerate(at(grid)) if holds(x)), None)
            if first is None or first == 0:
                return low if first == 0 else none
            low, high = grid[first - 1], grid[first]
            if not low < high:
                break
        return high

    limited = least(lambda x: x[2] * budget <= most_repeats * (1 + 1e-12)) if most_repeats is not None else 0.0
    if target_entropy is None:
        return limited
    if at([1.0])[0][1] >= target_entropy:
        # beyond 1 the entropy falls and large sources are repeated more often; the last exponent before that is wanted
        over = lambda x: x[1] < target_entropy or (most_repeats is not None and x[2] * budget > most_repeats * (1 + 1e-12))
        return least(over, 1.0, most) if most > 1 else 1.0
    # entropy falls with the exponent: the last exponent before it is too low
    return max(limited, least(lambda x: x[1] < target_entropy))


def _first_over(rows: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Of each source the first row, in order, with which the running sum of t exceeds rest; rest becomes what was left before it."""
    w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("run", F.sum("t").over(w)).filter((F.col("run") > F.col("rest")) & (F.col("run") - F.col("t") <= F.col("rest")))
    return run.select("source", (F.col("rest") - F.col("run") + F.col("t")).alias("rest"), "epochs", *keep)


def _cells(doc: Column, seed: int) -> list[Column]:
    """Block and cell of a document."""
    return [F.pmod(F.xxhash64(F.lit(seed + k), doc), F.lit(BLOCKS)).cast("int") for k in (1, 2)]


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _keys(seed: int) -> dict[str, Column]:
    """Every epoch has its own order of blocks, of cells in a block and of documents in a cell."""
    key = lambda k, *c: F.xxhash64(F.lit(seed), F.col("epochs"), F.lit(k), *map(F.col, c))
    return {"k1": key(1, "source", "b1"), "k2": key(2, "source", "b1", "b2"), "k3": key(3, "doc_id")}


def plan_mix(docs: DataFrame, target_entropy: float | None = ENTROPY, most_repeats: float | None = MOST_REPEATS, budget_share: float = BUDGET_SHARE, seed: int = SEED, n_tokens: Column | None = None) -> DataFrame:
    """One row a source: source (tagged), weight, epochs (whole ones), partial, cut (where the partial one ends)."""
    count = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)) if n_tokens is None else n_tokens
    b1, b2 = _cells(_doc(), seed)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), count.cast("long").alias("t"), b1.alias("b1"), b2.alias("b2"))
    base = materialize(base, "mix")
    sources = materialize(base.groupBy("source").agg(F.sum("t").alias("t")), "sources")
    n, total = sources.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0))).first()
    sources = sources.withColumn("share", F.col("t") / F.lit(max(1, total)).cast("double"))
    budget = budget_share * total
    exponent = bisect_exponent(lambda grid: moments(sources, grid), budget, target_entropy, most_repeats, MOST_EXPONENT)
    weight = F.when(F.col("t") > 0, F.pow("share", F.lit(exponent)) / F.lit(moments(sources, [exponent])[0][0])).otherwise(0.0)
    quota = F.floor(F.col("weight") * F.lit(budget) + 1e-6).cast("long")
    planned = sources.withColumn("weight", weight).withColumn("quota", quota)
    planned = planned.select(
        "source",
        "weight",
        F.when(F.col("t") > 0, F.expr("quota div t")).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("t") > 0, F.col("quota") % F.col("t")).otherwise(0).cast("long").alias("rest"),
        ((F.col("t") == 0) | (F.col("quota") % F.col("t") != 0)).alias("partial"),
    )
    plan = materialize(planned, "plan")
    small = F.broadcast if n <= MOST_BROADCAST else lambda d: d
    k1, k2, k3 = _keys(seed).values()
    blocks = base.groupBy("source", "b1").agg(F.sum("t").alias("t")).join(small(plan.filter("partial and rest > 0").drop("weight", "partial")), "source")
    cut1 = _first_over(blocks.withColumn("k1", k1), ["k1", "b1"], ["b1", "k1"])
    cells = base.join(small(cut1), ["source", "b1"]).groupBy("source", "b1", "b2", "rest", "epochs", "k1").agg(F.sum("t").alias("t"))
    cut2 = _first_over(cells.withColumn("k2", k2), ["k2", "b2"], ["b1", "k1", "b2", "k2"])
    last = base.join(small(cut2), ["source", "b1", "b2"]).withColumn("k3", k3)
    cut3 = _first_over(last.withColumn("order", _order()), ["k3", "doc_id"], ["order"]).select("source", F.col("order").alias("cut"))
    return materialize(plan.join(cut3, "source", "left"), "mix")


def _order() -> Column:
    return F.struct("k1", "b1", "k2", "b2", "k3", _doc().alias("doc"))


def copies(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source and others) with b1, weight and copies, the number of epochs that take the document; no shuffle of docs where the plan is small."""
    b1, b2 = _cells(_doc(), seed)
    tagged = docs.withColumns({"source": _source(), "doc_id": F.col("doc_id").cast("long"), "b1": b1, "b2": b2})
    small = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    met = tagged.join(F.broadcast(plan) if small else plan, "source").withColumns(_keys(seed))
    in_part = F.col("partial") & (F.col("cut").isNull() | (_order() < F.col("cut")))
    return met.withColumn("copies", F.col("epochs").cast("int") + in_part.cast("int")).drop("b2", "k1", "k2", "k3", "cut", "epochs", "partial", "rest")


def mix_sources(docs: DataFrame, target_entropy: float | None = ENTROPY, most_repeats: float | None = MOST_REPEATS, budget_share: float = BUDGET_SHARE, seed: int = SEED, n_tokens: Column | None = None) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_order, weight: one row for each time that a document is taken.

    The budget is ``budget_share`` of all tokens; tokens are words unless ``n_tokens`` says
    otherwise. A source's total stays within its quota and falls short by less than one document.
    Null source is a source of its own. Null and empty texts have no tokens: they cost nothing and
    are taken where the order comes to them; sources of such texts alone are taken once. Rows that
    repeat a doc_id go together. Other columns are not read.
    """
    count = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)) if n_tokens is None else n_tokens
    plan = plan_mix(docs, target_entropy, most_repeats, budget_share, seed, n_tokens)
    taken = copies(docs.select("doc_id", "source", count.cast("long").alias("n_tokens")), plan, seed).filter("copies > 0")
    each = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select(
        "doc_id",
        F.when(F.col("source") != "null", F.substring("source", 2, 2**31 - 1)).alias("source"),
        "n_tokens",
        "epoch",
        F.col("b1").alias("block"),
        F.xxhash64(F.lit(seed), F.col("epoch").cast("long"), F.lit(1), F.col("source"), F.col("b1")).alias("block_order"),
        "weight",
    )
