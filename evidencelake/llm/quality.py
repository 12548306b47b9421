"""Quality rules: a hashed n-gram log-likelihood ratio beside rules on words, in DataFrame functions alone.

Words and word pairs are hashed into ``BUCKETS``. Two multinomials over the buckets are estimated:
one of trusted target texts, one of the raw corpus, every document of it. A document's score is the
mean over its n-grams of log p_target / p_raw, and documents below ``THRESHOLD`` are rejected, always
by that rule and never by chance.

The corpus statistics are one pass with a map-side combine to ``BUCKETS`` rows; scoring is a
projection. The only table that reaches the driver has ``BUCKETS`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

BUCKETS = 8192
#: Trusted documents behind the target multinomial, chosen by a hash of doc_id: at most about so
#: many ids are broadcast. The raw multinomial has no such limit.
TARGET_DOCS = 20_000
THRESHOLD = -0.05
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def _hashed(docs: DataFrame) -> DataFrame:
    """text becomes n (words), one (hashes of the words) and two (of the word pairs)."""
    split = docs.withColumn("w", words(F.col("text")))
    one = split.withColumn("n", F.size("w")).withColumn("one", F.transform("w", lambda w: F.xxhash64(w)))
    head, tail = (F.slice("one", i, F.greatest(F.col("n") - 1, F.lit(0))) for i in (1, 2))
    return one.withColumn("two", F.zip_with(head, tail, lambda a, b: F.xxhash64(a, b)))


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of those whose doc_id is in ``trusted`` (small: broadcast)."""
    ids = F.broadcast(trusted.select("doc_id").distinct().withColumn("trusted", F.lit(1)))
    grams = _hashed(docs.select("doc_id", "text").join(ids, "doc_id", "left")).select(F.explode(F.concat("one", "two")).alias("h"), "trusted")
    return grams.groupBy(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log p_target / p_raw of each bucket, one added to every count; zeros where there is no target."""
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw) / sum(target))
    return [round(math.log(t / r) + shift, 4) for t, r in zip(target, raw)]


def trusted_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """About ``most`` ids of documents labelled as good, chosen by a hash of doc_id."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    rate = min(1.0, most / max(1, good.count()))
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)


def score(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept; no shuffle."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    ratio = lambda h: F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, h: acc + ratio(h))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    d = _hashed(docs.withColumn("text", text))
    d = d.withColumn("lines", lines)
    tri = F.zip_with(F.slice("two", 1, F.greatest(F.col("n") - 2, F.lit(0))), F.slice("one", 3, F.greatest(F.col("n") - 2, F.lit(0))), lambda p, c: F.xxhash64(p, c))
    d = d.withColumn("tri", tri)
    # only texts in which some window recurs are sorted
    ordered = F.when(F.size("tri") > F.size(F.array_distinct("tri")), F.sort_array(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("ordered", ordered)
    beside = lambda x, i: (x["h"] == F.get("ordered", i - 1)["h"]) | (x["h"] == F.get("ordered", i + 1)["h"])
    again = F.filter(F.transform("ordered", lambda x, i: F.when(beside(x, i), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumns({
        "n_words": F.col("n").cast("long"),
        "word_chars": F.length(F.array_join("w", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("ordered").isNull(), 0).otherwise(covered).cast("long"),
        "llr": (total("one") + total("two")) / F.greatest(F.size("one") + F.size("two"), F.lit(1)),
    })
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD)).drop("w", "n", "one", "two", "lines", "tri", "ordered")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of every row.

    Null, empty and blank texts have no word, all counts 0, llr 0 and base_failed. A null doc_id is
    never trusted and is judged like any other; rows that repeat a doc_id are judged each. Without
    trusted labels every llr is 0, so only the base rules reject. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratios = log_ratios(bucket_counts(base, trusted_ids(labels)))
    return score(base, ratios).drop("text")
