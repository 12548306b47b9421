"""Conversations and evidence kept between turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.urls import canonical_url, citation_id, conversation_url_key
from .selection import first_by, ordered, top_rows

EVIDENCE = "array<struct<title:string,url:string,chunks:array<struct<chunk_id:string,text:string>>>>"
HAN = re.compile(T.HAN)
CAPSULE = f"struct<version:int,turn_id:string,standalone_question:string,queries:array<string>,evidence:{EVIDENCE}>"


def explicit_urls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, urls (at most 5), overflow, total: the URLs written in a message, distinct by key, first spelling kept."""
    trimmed = lambda u: F.regexp_replace(u, r"[.,;:!?'\"\]]+$", "")
    opened = lambda u: F.regexp_count(u, F.lit(r"\("))
    closed = lambda u: F.regexp_count(u, F.lit(r"\)"))
    balanced = lambda u: F.when(closed(u) > opened(u), trimmed(F.regexp_replace(trimmed(u), r"\)+$", ""))).otherwise(trimmed(u))
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?i){C.EXPLICIT_URL}"), 0), balanced)
    keyed = F.transform(found, lambda u: F.struct(u.alias("u"), canonical_url(u).alias("k")))
    once = T.let(keyed, lambda p: F.filter(p, lambda x, i: F.array_position(F.transform(p, lambda y: y["k"]), x["k"]) == i + 1))
    out = messages.withColumn("_u", once)
    return out.select("conv_id", "turn", F.transform(F.slice("_u", 1, C.DIRECT_URLS), lambda x: x["u"]).alias("urls"), (F.size("_u") > C.DIRECT_URLS).alias("overflow"), F.size("_u").alias("total"))


def keywords(text: Column) -> Column:
    """Distinct words of two characters or more, and pairs of neighbouring Han characters."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(r"(?U)[\w-]{2,}"), 0)
    han = F.array_join(F.regexp_extract_all(lowered, F.lit(T.HAN), 0), "")
    pairs = F.when(F.length(han) > 1, F.transform(F.sequence(F.lit(1), F.length(han) - 1), lambda i: F.substr(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def history_window(messages: DataFrame) -> DataFrame:
    """conv_id, at, role, content: the first 2 and last 14 of more than 16 messages, contents cut by role and age."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    content = T.cut(F.col("text"), 12000)
    clean = messages.withColumn("content", content).filter(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    n, i = F.count("*").over(Window.partitionBy("conv_id")), F.row_number().over(order)
    placed = clean.withColumns({"n": n, "i": i})
    heads = F.collect_set(F.when((F.col("i") <= 2) & (F.col("n") > C.HISTORY_MESSAGES), F.struct("role", "content"))).over(Window.partitionBy("conv_id"))
    kept = placed.withColumn("heads", heads).filter((F.col("n") <= C.HISTORY_MESSAGES) | (F.col("i") <= 2) | ((F.col("i") > F.col("n") - (C.HISTORY_MESSAGES - 2)) & ~F.array_contains("heads", F.struct("role", "content"))))
    recent = F.sum((F.col("role") == "assistant").cast("int")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    kept = kept.withColumn("full", (F.col("role") == "assistant") & (recent <= 2)).withColumn("at", F.row_number().over(order) - 1)
    cut = F.when(F.col("full"), T.cut(F.col("content"), 6000)).when(F.col("role") == "assistant", T.excerpt(F.col("content"))).otherwise(T.cut(F.col("content"), 1800))
    return kept.select("conv_id", "turn", "at", "role", "full", cut.alias("content"))


def _est(text: str) -> int:
    han = 0 if text.isascii() else len(HAN.findall(text))
    return han + (len(text) - han + 3) // 4


def _cut(text: str, most: int) -> str:
    text = text.strip()
    if len(text) <= most:
        return text
    head = max(80, int(most * 0.72))
    return f"{text[:head].rstrip()}\n…（內容已受控截短）…\n{text[-max(40, most - head - 24) :].lstrip()}"


def shrink_history(history: DataFrame, budget: int = C.HISTORY_TOKENS) -> DataFrame:
    """While a conversation is over the budget its first long older answer, else its first long message, is halved (16 rows at most a group)."""

    def shrink(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at").reset_index(drop=True)
        texts = g["content"].tolist()
        while sum(map(_est, texts)) > budget:
            old = [i for i, t in enumerate(texts) if g["role"][i] == "assistant" and not g["full"][i] and len(t) > 480] or [i for i, t in enumerate(texts) if len(t) > 800]
            if not old:
                break
            shorter = _cut(texts[old[0]], max(360, len(texts[old[0]]) // 2))
            if len(shorter) >= len(texts[old[0]]):
                break
            texts[old[0]] = shorter
        return g.assign(content=texts)

    return history.groupBy("conv_id").applyInPandas(shrink, ", ".join(f"{n} {t}" for n, t in history.dtypes))


def recent_conversations(conversations: DataFrame, n: int = 24) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "conv_id").limit(n)


def distinct_chunks(chunks: Column) -> Column:
    """Chunks without repeats, in order. Where ids repeat, chunks are told apart as strings, which Spark hashes; it would compare each struct with all before it."""
    key = lambda chunks: F.transform(chunks, lambda c: F.concat(F.coalesce(F.length(c["chunk_id"]), F.lit(-1)), F.lit(":"), F.coalesce(c["chunk_id"], F.lit("")), F.coalesce(F.concat(F.lit("="), c["text"]), F.lit(""))))
    ids = lambda chunks: F.array_distinct(F.transform(chunks, lambda c: c["chunk_id"]))

    def chunk(k: Column) -> Column:
        size = F.substring_index(k, ":", 1)
        at, n = F.length(size) + 2, F.greatest(size.cast("int"), F.lit(0))
        text = F.substr(k, at + n, F.length(k))
        return F.struct(F.when(~size.startswith("-"), F.substr(k, at, n)).alias("chunk_id"), F.when(text != "", F.substr(text, F.lit(2), F.length(text))).alias("text"))

    return T.let(chunks, lambda all_: F.when(F.size(ids(all_)) == F.size(all_), all_).otherwise(F.transform(F.array_distinct(key(all_)), chunk)))


def clean_evidence(evidence: Column, turn_id: Column | None = None) -> Column:
    """Sources with a URL and chunks with a text; chunk ids carry the turn once, (id, text) pairs are distinct, titles fall back to the URL."""

    def chunk(c: Column, i: Column, turn: Column) -> Column:
        own = F.coalesce(F.nullif(c["chunk_id"], F.lit("")), F.concat(F.lit("C"), (i + 1).cast("string")))
        named = own if turn_id is None else F.when((turn == "") | own.startswith(F.concat(turn, F.lit(":"))), own).otherwise(F.concat(turn, F.lit(":"), own))
        return F.struct(named.alias("chunk_id"), F.trim(F.coalesce(c["text"], F.lit(""))).alias("text"))

    def source(s: Column, turn: Column) -> Column:
        url = F.trim(F.coalesce(s["url"], F.lit("")))
        chunks = F.filter(F.transform(F.coalesce(s["chunks"], F.array().cast("array<struct<chunk_id:string,text:string>>")), lambda c, i: chunk(c, i, turn)), lambda c: c["text"] != "")
        return F.struct(T.cut(F.coalesce(F.nullif(s["title"], F.lit("")), url), 800).alias("title"), url.alias("url"), distinct_chunks(chunks).alias("chunks"))

    # bound once: what evidence and turn are made of would otherwise be computed for each chunk
    known = F.struct(F.coalesce(evidence, F.array().cast(EVIDENCE)).alias("e"), (F.lit("") if turn_id is None else turn_id).alias("turn"))
    return T.let(known, lambda k: F.filter(F.transform(k["e"], lambda s: source(s, k["turn"])), lambda s: (s["url"] != "") & (F.size(s["chunks"]) > 0)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the task number, which is not a function of the row, keeps it a projection of its own."""
    return df.withColumn("_o", F.struct(value.alias("v"), F.spark_partition_id().alias("task"))).withColumn(name, F.col("_o.v")).drop("_o")


def pack_tokens(chunks: DataFrame, group: list[str], budget: int) -> DataFrame:
    """Chunks (group, source_rank, chunk_rank, chunk_id, text) that fit a token budget, taken in turns over sources; one that is too large is cut, and skipped if it is still too large.

    A skipped row costs nothing, so any later row may still fit: all rows are looked at. They come in order of their
    group, and what is kept of a group is the tokens used and the slots filled, however many rows it has.
    """
    given = chunks.columns
    names = [*given, "slot", "tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, slot = None, 0, 0
        for batch in batches:
            kept, texts, slots, tokens, column = [], [], [], [], batch.column("text")
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in group))):
                if key != now:
                    now, used, slot = key, 0, 0
                if (left := budget - used) <= 0:
                    continue
                text = (column[i].as_py() or "").strip()
                if (n := _est(text)) > left:
                    text = _cut(text, max(240, left * 3))
                    n = _est(text)
                if text and n <= left:
                    for made, x in ((kept, i), (texts, text), (slots, slot), (tokens, n)):
                        made.append(x)
                    used, slot = used + n, slot + 1
            rows = batch.take(pa.array(kept, pa.int64()))
            own = [pa.array(texts, column.type) if c == "text" else rows.column(c) for c in given]
            yield pa.RecordBatch.from_arrays([*own, pa.array(slots, pa.int64()), pa.array(tokens, pa.int64())], names)

    dealt = chunks.repartition(*group).sortWithinPartitions(*group, "chunk_rank", "source_rank")
    return dealt.mapInArrow(pack, ", ".join(f"{n} {t}" for n, t in chunks.dtypes) + ", slot long, tokens long")


def pack_capsules(capsules: DataFrame, budget: int = C.CAPSULE_TOKENS) -> DataFrame:
    """Capsules (turn_id, evidence, ...) whose chunks, taken in turns over sources, fit the budget; sources and chunks stay in order, and sources without a chunk go."""
    clean = _once(capsules.select("turn_id", "evidence"), "evidence", clean_evidence(F.col("evidence"), F.col("turn_id")))
    each = clean.select("turn_id", F.posexplode("evidence").alias("source_rank", "s"))
    rows = each.select("turn_id", "source_rank", "s.title", "s.url", F.posexplode("s.chunks").alias("chunk_rank", "c")).select("turn_id", "source_rank", "title", "url", "chunk_rank", "c.chunk_id", "c.text")
    taken = pack_tokens(rows, ["turn_id"], budget)
    sources = taken.groupBy("turn_id", "source_rank").agg(F.first("title").alias("title"), F.first("url").alias("url"), ordered(F.struct("chunk_id", "text"), ["chunk_rank"]).alias("chunks"))
    packed = sources.groupBy("turn_id").agg(ordered(F.struct("title", "url", "chunks"), ["source_rank"]).alias("evidence"))
    return capsules.drop("evidence").join(packed, "turn_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(EVIDENCE)))


def seal_capsules(capsules: DataFrame, key: str) -> DataFrame:
    """turn_id, token: capsules (turn_id, standalone_question, queries, evidence), packed to CAPSULE_TOKENS, as authenticated ciphertext."""
    capsules = pack_capsules(capsules)
    body = F.struct(
        F.lit(C.CAPSULE_VERSION).alias("version"), "turn_id", T.cut(F.col("standalone_question"), 4000).alias("standalone_question"),
        F.slice(F.transform(F.filter("queries", lambda q: F.trim(q) != ""), lambda q: T.cut(q, 600)), 1, 3).alias("queries"), "evidence",
    )
    return capsules.select("turn_id", F.base64(F.aes_encrypt(F.to_json(body), F.lit(key), F.lit("GCM"))).alias("token"))


def unseal_capsules(tokens: DataFrame, key: str) -> DataFrame:
    """Capsules of the first eight tokens (conv_id, at, token) of each conversation; blank, overlong, tampered, foreign and empty ones are left out."""
    first = top_rows(tokens, ["conv_id"], ["at"], 8).filter((F.trim(F.coalesce("token", F.lit(""))) != "") & (F.length("token") <= 180000))
    plain = F.try_aes_decrypt(F.expr("try_to_binary(token, 'base64')"), F.lit(key), F.lit("GCM")).cast("string")
    opened = _once(first, "c", F.from_json(plain, CAPSULE)).filter(F.col("c.version") == C.CAPSULE_VERSION)
    cleaned = _once(opened, "evidence", clean_evidence(F.col("c.evidence"), F.coalesce("c.turn_id", F.lit(""))))
    return cleaned.select("conv_id", "at", "c.turn_id", "c.standalone_question", "c.queries", "evidence").filter(F.size("evidence") > 0)


def research_ledger(capsules: DataFrame) -> DataFrame:
    """One row a capsule: question, queries, up to ten numbered sources, and how many chunks it holds."""
    sources = F.transform(F.slice("evidence", 1, 10), lambda s, i: F.struct(F.concat("turn_id", F.lit(":S"), (i + 1).cast("string")).alias("source_ref"), s["title"].alias("title"), s["url"].alias("url")))
    n = F.aggregate("evidence", F.lit(0), lambda a, s: a + F.size(s["chunks"]))
    return capsules.select("conv_id", "at", "turn_id", F.col("standalone_question").alias("question"), "queries", sources.alias("sources"), n.alias("selected_chunk_count"))


def refreshable_sources(ledger: DataFrame, refs: DataFrame, most: int = C.REFRESH_URLS) -> DataFrame:
    """Requested source_refs (conv_id, ordinal, source_ref) that the ledger (conv_id, source_ref, title, url) knows, distinct by URL, the first ``most``."""
    found = refs.join(ledger, ["conv_id", "source_ref"]).withColumn("url_key", conversation_url_key(F.col("url"))).filter("url_key <> ''")
    return first_by(found, ["conv_id", "url_key"], ["ordinal"], most, ["conv_id"]).drop("url_key")


def exclude_sources(evidence: DataFrame, urls: DataFrame) -> DataFrame:
    """Evidence rows (conv_id, url, ...) whose URL was not read again."""
    key = conversation_url_key(F.col("url"))
    return evidence.withColumn("_k", key).join(urls.select("conv_id", key.alias("_k")).filter("_k <> ''").distinct(), ["conv_id", "_k"], "left_anti").drop("_k")


REFRESHED = "Refreshed verified source"


def merge_refreshed(pages: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Pages read again come first, each URL once and unless it is there already; those of a false ``success`` (if there is such a column) are left to ``refresh_failures``."""
    key = canonical_url(F.col("url"))
    read = refreshed.filter("success").drop("success") if "success" in refreshed.columns else refreshed
    once = first_by(read.withColumn("_k", key).filter("_k <> ''"), ["research_id", "_k"], ["page_order"])
    fresh = once.join(pages.select("research_id", key.alias("_k")), ["research_id", "_k"], "left_anti").drop("_k")
    both = fresh.withColumn("_new", F.lit(0)).unionByName(pages.withColumn("_new", F.lit(1)))
    return both.withColumn("page_order", F.row_number().over(Window.partitionBy("research_id").orderBy("_new", "page_order"))).drop("_new")


def refresh_failures(failed: DataFrame, refreshed: DataFrame) -> DataFrame:
    """failed (research_id, url, from_query, ...) and after them pages that could not be read again (success is not true)."""
    lost = refreshed.filter(~F.coalesce("success", F.lit(False))).withColumn("from_query", F.lit(REFRESHED))
    return failed.unionByName(lost.select(*(c if c in lost.columns else F.lit(None).cast(t).alias(c) for c, t in failed.dtypes)))


def merge_evidence(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Sources (conv_id, source_order, title, url) with chunks (array) of the current and the prior turns as one numbered list.

    Current ones come first; URLs meet by the conversation key; chunks are distinct by id and text, in order.
    """
    both = current.withColumn("_p", F.lit(0)).unionByName(prior.withColumn("_p", F.lit(1)))
    keyed = both.withColumn("k", conversation_url_key(F.col("url"))).filter((F.col("k") != "") & (F.size("chunks") > 0))
    at = F.struct("_p", "source_order")
    merged = keyed.groupBy("conv_id", "k").agg(F.min(at).alias("first"), F.min_by("title", at).alias("title"), F.min_by("url", at).alias("url"), distinct_chunks(F.flatten(ordered(F.col("chunks"), ["_p", "source_order"]))).alias("chunks"))
    numbered = merged.withColumn("source_index", F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))).withColumn("citation_id", citation_id(F.col("url")))
    return numbered.withColumn("citation_marker", F.format_string("[citation](%d:%s)", "source_index", "citation_id")).drop("k", "first")


def relevant_prior(sources: DataFrame, questions: DataFrame, budget: int = C.REUSE_TOKENS) -> DataFrame:
    """Chunks of earlier sources (conv_id, recency, source_order, title, url, chunks) for a question, by how many of its keywords a source has, newer first, within the budget."""
    searchable = F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.transform("chunks", lambda c: c["text"])))
    hits = T.let(searchable, lambda s: F.size(F.filter(keywords(F.col("question")), lambda w: F.contains(s, w))))
    scored = sources.join(questions, "conv_id").withColumn("score", hits)
    order = [F.desc("score"), "recency", "source_order"]
    once = first_by(scored.withColumn("_k", conversation_url_key(F.col("url"))).filter("_k <> ''"), ["conv_id", "_k"], order)
    ranked = once.withColumn("source_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    each = ranked.select("conv_id", "source_rank", "title", "url", "score", F.posexplode("chunks").alias("chunk_rank", "c")).select("conv_id", "source_rank", "chunk_rank", "title", "url", "score", "c.chunk_id", "c.text")
    return pack_tokens(each, ["conv_id"], budget)
