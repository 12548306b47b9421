"""Which of very many keywords a text has, in any case.

Keywords up to a measured size go to every task as one multi-pattern automaton, which reads a text
once whatever their number. More than that meet texts in a join on character grams: a keyword is
filed under the one of its grams that the fewest texts have, and what meets is looked at again.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..sources.tables import written

#: Keywords of more bytes than this, with so many for each, are joined.
MOST_BYTES, EACH = 8 << 20, 64
GRAM = 3


@lru_cache(1)
def _automaton(broadcast: Broadcast):
    """A function of a text: positions of the words that it has. One automaton a process."""
    words = broadcast.value
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [i for i, w in enumerate(words) if w in text]
    tree = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            tree.add_word(w, i)
    always = [i for i, w in enumerate(words) if not w]
    if not len(tree):
        return lambda _: always
    tree.make_automaton()
    return lambda text: always + sorted({i for _, i in tree.iter(text)})


def _by_automaton(texts: Column, words: list[str], spark) -> Column:
    """Array of the lower-case words that each lower-case text has."""
    held = spark.sparkContext.broadcast(words)

    @arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        read = _automaton(held)
        return pa.array([[held.value[i] for i in read(t)] for t in column.to_pylist()], pa.list_(pa.string()))

    return found(texts)


def _grams(text: Column) -> Column:
    """Runs of GRAM characters; a shorter text is its only one."""
    n = F.greatest(F.length(text) - GRAM, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i + 1, F.lit(GRAM))))


def _short(text: Column) -> Column:
    """Runs of fewer than GRAM characters, for keywords that are no longer."""
    runs = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*(runs(k) for k in range(1, GRAM)))))


def _by_grams(pages: DataFrame, words: DataFrame) -> DataFrame:
    texts = written(pages.withColumns({"_low": F.lower(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()}), "probe")
    words = words.select(F.lower("keyword").alias("_word")).distinct()
    every = texts.select("_row", F.explode(F.array_union(_grams(F.col("_low")), _short(F.col("_low")))).alias("_gram"))
    often = every.groupBy("_gram").agg(F.count("*").alias("_n"))
    filed = words.filter("_word <> ''").select("_word", F.explode(_grams(F.col("_word"))).alias("_gram")).join(often, "_gram", "left")
    # a gram that no text has stands first: its word is in no text
    rarest = Window.partitionBy("_word").orderBy(F.asc_nulls_first("_n"), "_gram")
    filed = filed.withColumn("_at", F.row_number().over(rarest)).filter("_at = 1 and _n is not null").select("_word", "_gram")
    met = every.join(filed, "_gram").select("_row", "_word").join(texts.select("_row", "_low"), "_row").filter(F.contains("_low", "_word")).select("_row", "_word")
    blank = texts.select("_row").crossJoin(F.broadcast(words.filter("_word = ''")))  # one word at most
    return met.unionByName(blank).join(texts, "_row").drop("_row", "_low")


def keyword_probe(pages: DataFrame, keywords: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """pages (text, ...) with each keyword (keywords: keyword) that their text has, in any case: one row a page and keyword.

    Equal keywords count once, null ones not; an empty keyword is in every text, and a null text is empty.
    """
    words = keywords.select(F.col("keyword").cast("string").alias("keyword")).filter("keyword is not null").distinct()
    size, n = words.agg(F.coalesce(F.sum(F.octet_length("keyword")), F.lit(0)), F.count("*")).first()
    if size + EACH * n > most_bytes:
        hits = _by_grams(pages, words)
        return hits.join(words.withColumn("_word", F.lower("keyword")), "_word").drop("_word")
    given: dict[str, list[str]] = {}
    for low, word in sorted(tuple(r) for r in words.select(F.lower("keyword"), "keyword").collect()):
        given.setdefault(low, []).append(word)
    found = _by_automaton(F.lower(F.coalesce("text", F.lit(""))), list(given), pages.sparkSession)
    hits = pages.withColumn("keyword", F.explode(found))
    if all(k == v[0] and len(v) == 1 for k, v in given.items()):
        return hits
    names = pages.sparkSession.createDataFrame([(k, w) for k, v in given.items() for w in v], "keyword string, _word string")
    return hits.join(names, "keyword").drop("keyword").withColumnRenamed("_word", "keyword")
