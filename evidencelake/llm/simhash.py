"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at
most 2 bits, then among the three there is, in cyclic order, a segment without an error followed by
one with at most one error. So the key of a fingerprint for such a pair of segments is the first
segment as it is and a Golay codeword index for the second one: the (23, 12) Golay code puts every
word within 3 bits of exactly one codeword, so the nearest codeword of one of two words that differ
in one bit is within 4 bits of the other. Each fingerprint is filed under the codewords within 4
bits of its segment (5.3 on average) and asked for under its nearest one; what meets is verified.

Copies share a fingerprint and are one node of the link graph, so a group of copies costs no pairs.
Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, utf8_parts

SHINGLE, SEED, MOST_BITS = 3, 42, 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Shingle hashes that are counted at once.
BLOCK = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half of the shingles' hashes; 0 for a text without words."""
    w = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), grams)
    counts, n, left = np.zeros(64, np.int64), 0, max(1, len(w) - shingle + 1)
    while left:
        h = np.fromiter(hashes, np.uint64, min(left, BLOCK))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n, left = n + len(h), left - len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8_parts(b.column("text"))], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return run


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 or less, and all errors of weight 4 or less (padded with the first)."""

    def syndrome(e: np.ndarray) -> np.ndarray:
        e = e.copy()
        for bit in range(22, 10, -1):
            e ^= np.where((e >> bit) & 1, GENERATOR << (bit - 11), 0)
        return e

    errors = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)], np.int64)
    of = syndrome(errors)
    order = np.argsort(of, kind="stable")  # within a syndrome the lightest error stays first
    counts = np.bincount(of, minlength=2048)
    starts = np.cumsum(counts) - counts
    table = np.zeros((2048, counts.max()), np.int64)
    for k in range(counts.max()):
        table[:, k] = errors[order[starts + np.minimum(k, counts - 1)]]
    return table, counts, np.array([syndrome(np.array([1 << b], np.int64))[0] for b in range(23)], np.int64)


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words: indices of the codewords within 4 bits, the nearest first, and how many there are."""
    table, counts, bit = _golay()
    s = np.zeros(len(segment), np.int64)
    for b in range(23):
        s ^= np.where((segment >> b) & 1, bit[b], 0)
    return (segment[:, None] ^ table[s]) >> 11, counts[s]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        parts = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
        key, asks, own = [], [], []
        for i in range(3):
            exact, fuzzy = parts[i], parts[(i + 1) % 3]
            index, n = golay_keys(fuzzy)
            keys = (i << 40) | (exact[:, None] << 12) | index
            filed = np.arange(keys.shape[1]) < n[:, None]
            rows = np.broadcast_to(np.arange(len(fp))[:, None], keys.shape)[filed]
            key += [keys[:, 0], keys[filed]]
            asks += [np.ones(len(fp), bool), np.zeros(int(filed.sum()), bool)]
            own += [fp, fp[rows]]
        yield pa.record_batch({"key": pa.array(np.concatenate(key)), "asks": pa.array(np.concatenate(asks)), "fp": pa.array(np.concatenate(own))})


def links(nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """a, b of all pairs of distinct fingerprints in ``nodes`` (fp) that differ in at most ``most_bits`` (0 to 2) bits."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError("the keys are complete for up to 2 bits")
    filed = materialize(nodes.select("fp").mapInArrow(_keys, "key long, asks boolean, fp long"), "golay")
    asks = filed.filter("asks").select("key", F.col("fp").alias("a"))
    held = filed.filter("not asks").select("key", F.col("fp").alias("b"))
    met = asks.join(held, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits))
    return met.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the undirected edges (a, b); root is the least node reachable.

    Large-star and small-star steps alternate until the edges are stars. Each round is a written
    table, so a lost executor costs one round at most.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = materialize(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if seen == mark and seen[0] == seen[2]:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp (64 bits as a long), component_id, n_links of every row of ``docs``.

    Texts are lower-cased (A-Z) and split at ASCII white space; null, empty and blank texts have
    fingerprint 0 and are linked like others. component_id is the smallest doc_id that is reachable
    over links, null only if all of them are null; n_links counts other fingerprints within reach
    of one link. Rows that repeat a doc_id are rows of their own. Other columns are not read.
    """
    own = materialize(documents(docs).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = materialize(links(nodes, most_bits), "links")
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    root = components(edges).withColumnRenamed("node", "fp")
    rooted = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(ids, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # written, so that both sides of the last join are shuffled and AQE can split a fingerprint with very many copies
    of = materialize(of, "simhash")
    return own.join(of, "fp").select("doc_id", "fp", "component_id", "n_links")
