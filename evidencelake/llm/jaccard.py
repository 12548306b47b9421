"""Near copies beyond the reach of fingerprints: Jaccard similarity of word shingles, beside SimHash links.

SimHash fingerprints of texts with a similarity of 0.8 differ in about ten of 64 bits, too many for
any keys. So texts whose fingerprints differ in at most 2 bits are linked by the Golay keys of
SimHash dedup, and those beyond are found by minimum hashes as follows.

Each set of shingles is filed under ``BANDS`` keys of ``ROWS`` minimum hashes. Sets that meet under
a key are compared exactly. Within a key the comparison goes from linked set to linked set and
looks at those alone that are not linked yet, so a group of near copies costs few comparisons and
gives one edge a set, and no pair that would join two groups is left out. A key with more than
``MOST`` shingles is cut into blocks, each of which meets every other. Texts with equal sets are one
node of the link graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, utf8_parts
from .simhash import components, links, majority

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Shingle hashes that are permuted at once.
BLOCK = 1 << 12
#: Shingles of one block of the sets under a key, about.
MOST = 1 << 20

_A, _B = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64)
_A = _A * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of ``shingle`` words, in order; a shorter text is one shingle, a text without words none."""
    w = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not w:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, max(1, len(w) - shingle + 1)))


def bands(h: np.ndarray) -> list[int]:
    """One key for each band of minimum hashes; none for an empty set."""
    if not len(h):
        return []
    least = np.min([(_A * h[i : i + BLOCK] + _B).min(1) for i in range(0, len(h), BLOCK)], axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(x.tobytes(), seed=i) - 2**63 for i, x in enumerate(least)]


SKETCH = "uid long, doc_id long, set_id long, fp long, n long, bands array<long>"


def _sketches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(stream):
        sets = [shingles(x) for x in utf8_parts(b.column("text"))]
        ids = [xxhash.xxh64_intdigest(h.tobytes(), seed=SEED) - 2**63 for h in sets]
        keys = pa.array([bands(h) for h in sets], pa.list_(pa.int64()))
        yield pa.record_batch({"uid": b.column("uid"), "doc_id": b.column("doc_id"), "set_id": pa.array(ids, pa.int64()), "fp": pa.array(np.array([majority(h) for h in sets], np.uint64).view(np.int64)), "n": pa.array([len(h) for h in sets], pa.int64()), "bands": keys})


def _sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(stream):
        yield pa.record_batch({"set_id": b.column("set_id"), "hashes": pa.array([shingles(x).tobytes() for x in utf8_parts(b.column("text"))], pa.binary())})


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges between sets of at least this similarity that connect whatever all such pairs connect."""
    sizes = np.array([len(x) for x in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(code, np.cumsum(sizes)[:-1])
    held = np.zeros(len(values), np.int64)
    left, stack, edges = np.arange(len(sets)), [], []
    flat = None
    while len(left):
        if not stack:
            stack, left, flat = [int(left[0])], left[1:], None
            continue
        one = stack.pop()
        if flat is None:
            flat = np.concatenate([codes[i] for i in left])
            first = np.cumsum(sizes[left]) - sizes[left]
        held[codes[one]] = 1
        common = np.add.reduceat(held[flat], first)
        held[codes[one]] = 0
        met = common / (sizes[one] + sizes[left] - common) >= least
        if met.any():
            stack += left[met].tolist()
            edges += [(one, i) for i in left[met].tolist()]
            left, flat = left[~met], None
    return edges


def _edges(least: float):
    """Edges of each run of equal (key, i, j); rows come in this order."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []

        def settle() -> pa.RecordBatch:
            found = linked(sets, least) if len(sets) > 1 else []
            return pa.record_batch({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

        for b in stream:
            for *unit, set_id, hashes in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "set_id", "hashes"))):
                if unit != at:
                    yield settle()
                    at, ids, sets = unit, [], []
                ids.append(set_id)
                sets.append(np.frombuffer(hashes, np.uint64))
        yield settle()

    return run


def fingerprint_edges(nodes: DataFrame) -> DataFrame:
    """Edges a, b between sets (set_id, fp) that connect whatever has fingerprints of at most 2 differing bits."""
    least = materialize(nodes.groupBy("fp").agg(F.min("set_id").alias("least")), "least")
    equal = nodes.select("fp", "set_id").join(least, "fp").select(F.col("set_id").alias("a"), F.col("least").alias("b")).filter("a <> b")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}"))
    close = materialize(links(least), "links").join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return equal.unionByName(close)


def near_groups(docs: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """doc_id and component_id of every row of ``docs``.

    Links are SimHash fingerprints of at most 2 differing bits, and a Jaccard similarity of ``least`` or more, over shingles of
    SHINGLE words, repeats left out. Texts are lower-cased (A-Z) and split at ASCII white space; those without words are one group.
    component_id is the smallest doc_id that is reachable over links,
    null only if all of them are null.
    """
    base = documents(docs).withColumn("uid", F.xxhash64("doc_id", "text"))
    own = materialize(base.mapInArrow(_sketches, SKETCH), "sketches")
    nodes = materialize(own.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.min("uid").alias("uid"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    filed = nodes.select("set_id", "n", F.explode("bands").alias("key"))
    # keys of equal members are asked once
    members = filed.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y")).filter("members > 1")
    once = members.groupBy("members", "total", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / most).alias("blocks"))
    # written, so that both sides are shuffled and AQE can split a key with very many sets
    met = materialize(filed.select("key", "set_id").join(materialize(once, "keys"), "key"), "members")
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    units = met.withColumn("at", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "set_id")
    asked = materialize(nodes.join(met.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "uid"), "asked")
    texts = base.select("uid", "text").join(asked, "uid")
    sets = materialize(texts.mapInArrow(_sets, "set_id long, hashes binary"), "hashes").dropDuplicates(["set_id"])
    dealt = units.join(sets, "set_id").select("key", "i", "j", "set_id", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    edges = dealt.mapInArrow(_edges(least), "a long, b long")
    root = components(edges.unionByName(fingerprint_edges(nodes))).withColumnRenamed("node", "set_id")
    rooted = nodes.select("set_id", "first").join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that AQE can split a set with very many copies
    of = materialize(rooted.join(ids, "root").select("set_id", "component_id"), "jaccard")
    return own.select("doc_id", "set_id").join(of, "set_id").select("doc_id", "component_id")
