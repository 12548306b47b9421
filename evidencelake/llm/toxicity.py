"""Toxicity by a counterfactual-regularised linear classifier.

Features are the words of a text and their first letters, present or not. From a bounded sample of
labelled rows, the features that tell the labels apart best are kept and a logistic model is
trained on them. For sampled texts that mention an identity term, the same text with that term
swapped for others is scored as well, and the squared change of the score is part of the loss: what
a text says of a group counts, which group it names does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize
from .langid import hash01

#: Sampled training rows of each label.
MOST_TOXIC, MOST_CLEAN = 2500, 4000
#: Features in the model; each must occur in so many sampled texts.
MOST_FEATURES, LEAST_TEXTS = 1500, 4
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, L2 = 300, 0.05, 1e-3
#: Weight of the counterfactual penalty.
SWAP = 4.0
#: Terms that may stand in for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("old", "young", "disabled", "blind", "deaf"),
)
#: Different changes of features by a swap that training looks at.
MOST_PAIRS = 20_000
#: Word memo of a task.
MEMO = 300_000

EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "«»“”‘’¡¿…–—"


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one white-space-separated word in lower case."""
    core = word.strip(EDGES)
    if not core:
        return ()
    return (_hash(f"={core}"), *(_hash(f"^{core[:k]}") for k in PREFIXES if len(core) > k))


def text_features(text: str | None) -> set[int]:
    return {f for w in set((text or "").lower().split()) for f in word_features(w)}


def swaps(text: str | None) -> list[set[int]]:
    """Features of the text with each identity term it mentions swapped for the others of its group."""
    found = [w.strip(EDGES) for w in (text or "").lower().split()]
    present, out = set(found), []
    for group in IDENTITY:
        for term in group:
            if term in present:
                out += [text_features(" ".join(other if w == term else w for w in found)) for other in group if other != term]
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(features))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _dense(rows: list[np.ndarray], of: np.ndarray, n: int) -> np.ndarray:
    """Presence of the model's features in each row; ``of`` has a feature's column by its hash, or -1."""
    x = np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        columns = of[r]
        x[i, columns[columns >= 0]] = 1
    return x


def _train(rows: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], times: np.ndarray, shift: float) -> ToxicityModel:
    """rows: hashed features of each text, without repeats; pairs: features that a swap takes away, and adds, and how often it does."""
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    prior = float(np.log((n1 + 1) / (n0 + 1))) + shift
    if not n1 or not n0:
        return ToxicityModel({}, prior)
    with_, without = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for r, t in zip(rows, toxic):
        (with_ if t else without)[r] += 1
    # likelihood-ratio statistic of each feature against the labels
    seen = np.flatnonzero(with_ + without >= LEAST_TEXTS)
    a, b = with_[seen].astype(float), without[seen].astype(float)
    tables = ((a, n1), (b, n0), (n1 - a, n1), (n0 - b, n0))
    total, rest = (a + b) / (n1 + n0), (n1 + n0 - a - b) / (n1 + n0)
    g2 = sum(2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(n * p, 1e-9)) for (o, n), p in zip(tables, (total, total, rest, rest)))
    keep = seen[np.lexsort((seen, -g2))[:MOST_FEATURES]]
    # what a swap changes is always in the model, to be held down
    features = np.unique(np.concatenate([keep, *(x for p in pairs for x in p)])).astype(np.int64)
    of = np.full(BUCKETS, -1, np.int32)
    of[features] = np.arange(len(features))
    x, y = _dense(rows, of, len(features)), toxic.astype(np.float32)
    # the change of a pair is sparse: its features, and 1 or -1 for each
    column = of[np.concatenate([np.empty(0, np.int64), *(x for p in pairs for x in p)]).astype(np.int64)]
    sign = np.repeat(np.tile([1.0, -1.0], len(pairs)), [len(x) for p in pairs for x in p])
    pair = np.repeat(np.arange(len(pairs)), [len(p[0]) + len(p[1]) for p in pairs])
    share = times / max(1, times.sum())
    w, bias = np.zeros(len(features), np.float32), prior - shift
    moment, scale = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        grad = x.T @ g / len(y) + L2 * w
        if len(pairs):
            change = np.bincount(pair, sign * w[column], len(pairs)) * share
            grad += (SWAP * np.bincount(column, sign * change[pair], len(w))).astype(np.float32)
        moment, scale = 0.9 * moment + 0.1 * grad, 0.999 * scale + 0.001 * grad**2
        w -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
        bias -= RATE * float(g.mean()) * 5
    return ToxicityModel(dict(zip(features.tolist(), w.tolist())), float(bias + shift))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        pack = lambda s: np.array(sorted(s), "<i4").tobytes()
        own = [text_features(t) for t in texts]
        pairs = [[{"gone": pack(o - s), "new": pack(s - o)} for s in swaps(t)] for t, o in zip(texts, own)]
        kind = pa.list_(pa.struct([("gone", pa.binary()), ("new", pa.binary())]))
        yield pa.record_batch({"h": b.column("h"), "toxic": b.column("toxic"), "own": pa.array([pack(o) for o in own], pa.binary()), "pairs": pa.array(pairs, kind)})


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Model from the texts of ``docs`` and doc_id, toxic of ``labels``.

    Of each label the MOST_TOXIC or MOST_CLEAN rows with the least hash of doc_id and text are
    gathered on the driver as features, equal rows once; about as many ids are broadcast. Swaps that change the same
    features are one pair with a count, at most MOST_PAIRS of them, the most frequent. A doc_id with several labels counts as toxic if one is.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {True: MOST_TOXIC, False: MOST_CLEAN}
    rates = {t: min(1.0, n / max(1, sizes.get(t, 0))) for t, n in most.items()}
    sample = known.filter(hash01(F.col("doc_id")) <= F.when(F.col("toxic"), rates[True]).otherwise(rates[False]))
    met = documents(docs).join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("toxic").cast("int").alias("toxic"))
    found = materialize(met.mapInArrow(_training_rows, "h long, toxic int, own binary, pairs array<struct<gone:binary,new:binary>>").dropDuplicates(["h", "toxic"]), "toxic")
    chosen = found.filter("toxic = 1").orderBy("h").limit(MOST_TOXIC).unionByName(found.filter("toxic = 0").orderBy("h").limit(MOST_CLEAN))
    got = chosen.select("toxic", "own").collect()
    got.sort(key=lambda r: (r["toxic"], bytes(r["own"])))
    swapped = chosen.select(F.explode("pairs").alias("p")).groupBy("p.gone", "p.new").count().orderBy(F.desc("count"), "gone", "new").limit(MOST_PAIRS).collect()
    unpack = lambda raw: np.frombuffer(raw, "<i4")
    # labels are sampled at different rates: the bias goes back to their true shares
    shift = float(np.log(rates[False] / rates[True]))
    return _train([unpack(r["own"]) for r in got], np.array([r["toxic"] for r in got], dtype=int), [(unpack(r["gone"]), unpack(r["new"])) for r in swapped], np.array([r["count"] for r in swapped], float), shift)


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            for t in b.column("text").to_pylist():
                features: set[int] = set()
                for w in set((t or "").lower().split()):
                    found = memo.get(w)
                    if found is None:
                        found = tuple(f for f in word_features(w) if f in model.weights)
                        if len(memo) < MEMO:
                            memo[w] = found
                    if found:
                        features.update(found)
                scores.append(model.score(features))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every row of ``docs``; no shuffle.

    Whole texts are read. Null and empty texts get the score of a text without features. A null
    doc_id stays null, rows that repeat a doc_id are scored each; other columns are not read.
    """
    scored = documents(docs).mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
