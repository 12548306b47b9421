"""Language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1. One linear classifier over hashed byte n-grams is
trained per bit of the code, on a bounded sample of labelled rows. A text's bit margins are decoded
to the codeword of least logistic loss, bits weighted by how well they did in training; a text
whose two best languages are close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

#: Training rows: at most so many of a language and of all, by a hash of doc_id and text; languages that are learned, the most frequent.
PER_LANG, MOST_ROWS, MOST_LANGS = 400, 6000, 1500
BUCKETS = 4096
STEPS, RATE, L2 = 150, 0.5, 1e-4
#: Texts whose best language leads by less than this probability are ambiguous.
MARGIN = 0.2
UNKNOWN = "und"
#: Bytes of a text whose n-grams are counted at once.
PIECE = 1 << 20


def ngram_counts(raw: bytes) -> np.ndarray:
    """Root counts, scaled to length 1, of the hashed byte 2- and 3-grams of a lower-case text, taken PIECE bytes at a time."""
    whole = np.frombuffer(b" " + raw + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(whole) - 1, PIECE):
        a = whole[at : at + PIECE + 2].astype(np.uint32)
        two = a[:-1] | (a[1:] << 8)
        three = two[:-1] | (a[2:] << 16)
        for grams, salt in ((two[:PIECE], 0x9E3779B1), (three, 0x85EBCA6B)):
            hashed = (grams * np.uint32(salt)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=BUCKETS)
    counts = np.sqrt(counts.astype(np.float32))
    return counts / max(float(np.sqrt((counts**2).sum())), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords as rows of +1 and -1: all non-trivial splits up to 5 classes, else the best of seeded draws."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        bits = [[1 if c == 0 or (k >> (c - 1)) & 1 else -1 for c in range(n)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, np.float32).T
    rng, width = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    draws = (rng.choice([-1.0, 1.0], (n, width)) for _ in range(200))
    apart = lambda m: min((width - m @ m.T)[np.triu_indices(n, 1)])
    return max(draws, key=apart).astype(np.float32)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability and its lead, of each row of n-gram counts."""
        margins = counts @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weight
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        ranked = np.sort(p, 1)
        lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
        return best, p[np.arange(len(p)), best], lead


def _train(x: np.ndarray, lang: np.ndarray, langs: tuple[str, ...]) -> LanguageModel:
    code = codewords(len(langs))
    y = code[lang]
    share = 1 / np.bincount(lang, minlength=len(langs))[lang]
    share = (share / share.sum()).astype(np.float32)[:, None]  # each language counts alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    moment, scale = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        grad = x.T @ g + L2 * w
        moment, scale = 0.9 * moment + 0.1 * grad, 0.99 * scale + 0.01 * grad**2
        w -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-6)
        b -= RATE * g.sum(0)
    right = (share * (y * (x @ w + b) > 0)).sum(0)
    return LanguageModel(langs, code, w, b, np.clip(2 * right - 1, 0.05, 1).astype(np.float32))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [ngram_counts((t or "").lower().encode()).astype("<f4").tobytes() for t in b.column("text").to_pylist()]
        yield pa.record_batch({"h": b.column("h"), "lang": b.column("lang"), "counts": pa.array(rows, pa.binary())})


def hash01(column: Column) -> Column:
    """A number from 0 to 1 that depends on the value alone."""
    return F.pmod(F.xxhash64(column), F.lit(1_000_000)) / 1_000_000


def fit(labelled: DataFrame) -> LanguageModel | None:
    """Model from doc_id, text, lang; rows without lang or text are left out. None if there is no row.

    The MOST_LANGS most frequent languages are learned. At most PER_LANG rows of each, and MOST_ROWS in all, equal rows once, are
    gathered on the driver, as n-gram counts of fixed size.
    """
    rows = labelled.filter("lang is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return None
    each = max(1, min(PER_LANG, MOST_ROWS // len(sizes)))
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * each / n))))
    some = rows.filter(hash01(F.col("h")) <= rate[F.col("lang")]).mapInArrow(_features, "h long, lang string, counts binary").dropDuplicates(["h", "lang"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got = some.withColumn("at", first).filter(F.col("at") <= each).select("lang", "counts").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["counts"])))  # the model depends on the rows, not on their order
    langs = tuple(sorted({r["lang"] for r in got}))
    x = np.stack([np.frombuffer(r["counts"], "<f4") for r in got])
    return _train(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def _predictor(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, letters = b.column("text").to_pylist(), b.column("letters").to_pylist()
            n = len(texts)
            lang, score, unsure = [UNKNOWN] * n, [0.0] * n, [True] * n
            known = [i for i in range(n) if letters[i]] if model else []
            for at in range(0, len(known), 256):
                some = known[at : at + 256]
                found = model.decode(np.stack([ngram_counts(texts[i].lower().encode()) for i in some]))
                for i, best, p, lead in zip(some, *found):
                    lang[i], score[i], unsure[i] = model.langs[best], float(p), bool(lead < MARGIN)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(lang), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure)})

    return run


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row of ``docs``; no shuffle.

    Whole texts are read. Null texts and texts without a letter, and all texts where nothing could
    be learned, get ``und`` with score 0 and count as ambiguous. A null doc_id stays null, rows that
    repeat a doc_id are predicted each, and columns other than doc_id and text are not read.
    """
    base = documents(docs).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return base.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, ambiguous boolean")
