"""Trace events folded into the state of a turn: batch, stream, and ingest of results without repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions.urls import canonical_url

#: One row an event and thing that it names; title, preview, text and stage may be missing.
EVENT = "turn_id long, seq long, type string, query string, url string, chunk_id string"
#: What an event of a type adds to, and the stage that it sets.
FIELDS = {"search_results": "sources", "url_selection": "selected_sources", "final_evidence": "final_chunks"}
#: The same for what belongs to no query.
DIRECT = {"direct_sources": "direct_sources", "refresh_sources": "direct_sources", "direct_evidence": "direct_chunks"}
STAGES = {"plan": "searching", "search_results": "url_judge", "url_selection": "crawling", "final_evidence": "evidence", "direct_sources": "direct_crawl", "refresh_sources": "direct_crawl", "direct_evidence": "chunk_judge"}
CHUNKS = ("final_evidence", "direct_evidence")
COUNTS = ("n_queries", "n_sources", "n_selected", "n_chunks", "n_direct_sources", "n_direct_chunks")
COUNT_OF = dict(zip(("queries", *FIELDS.values(), *dict.fromkeys(DIRECT.values())), COUNTS))
STATE = f"turn_id long, stage string, n_events long, {', '.join(f'{c} long' for c in COUNTS)}"
#: What the state store holds of a turn, whatever its length; its items are keys of their own.
FOLDED = f"stage string, at long, n long, latest long, {', '.join(f'{c} long' for c in COUNTS)}"
#: A turn without events for so long is forgotten, if events carry their time.
IDLE_S = 3600


def _of(events: DataFrame, name: str) -> Column:
    """A column, null where it is missing or empty."""
    return F.nullif(F.col(name), F.lit("")) if name in events.columns else F.lit(None).cast("string")


def _chunk_preview(events: DataFrame) -> Column:
    return F.coalesce(_of(events, "preview"), F.nullif(T.preview(_of(events, "text")), F.lit("")))


def _item(events: DataFrame) -> Column:
    """What makes a source the same: its URL, or else its title; a chunk: its id, or else URL and preview."""
    url = _of(events, "url")
    chunk = F.coalesce(_of(events, "chunk_id"), F.concat(F.coalesce(url, F.lit("")), F.lit(":"), _chunk_preview(events)))
    return F.when(F.col("type").isin(*CHUNKS), chunk).otherwise(F.coalesce(url, _of(events, "title")))


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in words.items() for x in p))[F.col("type")]


def _stage(events: DataFrame) -> Column:
    """The stage that an event sets: its own, or that of its type; null if it sets none."""
    return F.coalesce(_of(events, "stage"), _lookup(STAGES))


def _parts(events: DataFrame, *more: str) -> DataFrame:
    """turn_id, part, query, item: a row for each query, source and chunk that an event names. What names no query belongs to none and counts where it may."""
    query, item = _of(events, "query"), _item(events)
    part = lambda name, q, x: F.struct(name.alias("part"), q.alias("query"), x.alias("item"))
    none = F.lit(None).cast("string")
    field, direct = _lookup(FIELDS), _lookup(DIRECT)
    every = F.array(
        F.when(F.col("type").isin("plan", *FIELDS) & query.isNotNull(), part(F.lit("queries"), query, none)),
        F.when(field.isNotNull() & query.isNotNull() & item.isNotNull(), part(field, query, item)), F.when(direct.isNotNull() & item.isNotNull(), part(direct, none, item)),
    )
    return events.select("turn_id", *more, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("p")).select("turn_id", *more, "p.*")


def trace_state(events: DataFrame) -> DataFrame:
    """State of each turn from all of its events: the stage that its latest event set, and how many distinct queries, sources, selected sources and chunks it has."""
    stage = _stage(events)
    last = events.groupBy("turn_id").agg(F.coalesce(F.max_by(stage, F.when(stage.isNotNull(), F.col("seq"))), F.lit("planning")).alias("stage"), F.count("*").alias("n_events"))
    # one row a distinct item first: the counts then combine before the shuffle
    sums = _parts(events).distinct().groupBy("turn_id").agg(*(F.count_if(F.col("part") == p).alias(c) for p, c in COUNT_OF.items()))
    return last.join(sums, "turn_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})


def trace_items(events: DataFrame) -> DataFrame:
    """turn_id, query, field, item, first_seq: each source and chunk of a turn's trace, the first time it is seen."""
    rows = _parts(events, "seq").filter(F.col("part").isin(*FIELDS.values()))
    return rows.groupBy("turn_id", "query", F.col("part").alias("field"), "item").agg(F.min("seq").alias("first_seq"))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of part ``event`` are events, all others things that the turn has not named before."""
    if state.hasTimedOut:
        state.remove()
        return
    stage, at, n, latest, *counts = state.get if state.exists else ("planning", None, 0, 0, *[0] * len(COUNTS))
    for rows in frames:
        events, new = rows[rows["part"] == "event"], rows["part"].value_counts()
        n += len(events)
        counts = [c + int(new.get(part, 0)) for part, c in zip(COUNT_OF, counts)]
        staged = events[events["stage"].notna()]
        if len(staged) and (at is None or staged["seq"].max() > at):  # what comes late does not set the stage back
            first = staged.loc[staged["seq"].idxmax()]
            stage, at = first["stage"], int(first["seq"])
        if "event_time" in rows and len(rows):
            latest = max(latest, int(rows["event_time"].max().timestamp() * 1000))
    state.update((stage, at, n, latest, *counts))
    if latest:
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + IDLE_S * 1000)
    yield pd.DataFrame({"turn_id": [key[0]], "stage": [stage], "n_events": [n]} | {c: [x] for c, x in zip(COUNTS, counts)})


def trace_state_stream(events: DataFrame) -> DataFrame:
    """The same state as a stream: the whole state of each turn that got events, one row a micro-batch.

    Each thing that a turn names is a key of the state store, so a batch costs what it brings, whatever the turn holds.
    Events with a column event_time expire: a turn is forgotten when the watermark, which is as long behind, passes IDLE_S after
    its latest event, and a thing when it passes IDLE_S after it was first named; named again later than that it counts again.
    Without event_time both are kept.
    """
    timed = "event_time" in events.columns
    rows = events.withWatermark("event_time", f"{IDLE_S} seconds") if timed else events
    more = ["event_time"] if timed else []
    named = _parts(rows, "seq", *more)
    keys = ["turn_id", "part", "query", "item"]
    new = named.dropDuplicatesWithinWatermark(keys) if timed else named.dropDuplicates(keys)
    every = rows.select("turn_id", "seq", F.lit("event").alias("part"), _stage(rows).alias("stage"), *more)
    both = every.unionByName(new.select("turn_id", "seq", "part", F.lit(None).cast("string").alias("stage"), *more))
    return both.groupBy("turn_id").applyInPandasWithState(_fold, STATE, FOLDED, "update", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def run_trace_stream(events: DataFrame, folder: str) -> DataFrame:
    """Fold what the stream has now, and give the last state of each turn. Batches are written below ``folder``, which all executors share."""
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = trace_state_stream(events).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(keep).start()
    query.awaitTermination()
    names = [x.split()[0] for x in STATE.split(", ")]
    found = spark.read.schema(f"{STATE}, batch int").parquet(f"{folder}/out")
    return found.groupBy("turn_id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s")).select("turn_id", "s.*")


def serp_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files as they come (ingest_time, research_id, query_ordinal, url, ...), with the canonical URL, each (research, query, URL) once within two hours."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("url_key", canonical_url(F.col("url"))).filter("url_key <> ''")
    return rows.withWatermark("ingest_time", "2 hours").dropDuplicatesWithinWatermark(["research_id", "query_ordinal", "url_key"])


def ingest_results(rows: DataFrame, folder: str) -> DataFrame:
    """Take what the stream of result rows (research_id, query_ordinal, url, ...) has now into the ledger below ``folder``, and give the ledger: each (research, query, canonical URL) once, ever.

    A batch keeps the first row of each key (by all columns in order, as a batch has none of its own) that no earlier batch has.
    Its place in the ledger goes by its number, so one that is run again after a failure replaces what it had written, and what
    a key has been given never changes. Rows without a URL are left out; no row is too late.
    """
    spark = rows.sparkSession
    keys = ["research_id", "query_ordinal", "url_key"]
    keyed = rows.withColumn("url_key", canonical_url(F.col("url"))).filter("url_key <> ''")
    ledger = f"{folder}/ledger"

    def take(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy(*keys).orderBy(*(c for c in batch.columns if c not in keys))
        new = batch.withColumn("_i", F.row_number().over(order)).filter("_i = 1").drop("_i")
        if number:
            before = batch.sparkSession.read.schema(f"{_ddl(keyed, keys)}, batch int").parquet(ledger).filter(F.col("batch") < number)
            new = new.join(before.select(*keys), [new[k].eqNullSafe(before[k]) for k in keys], "left_anti")
        new.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    query = keyed.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(take).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(keyed, keyed.columns)}, batch int").parquet(ledger)


def _ddl(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def trace_events(events: DataFrame) -> DataFrame:
    """Events as they are shown: turn_id, seq, at (their order), type, query, and title and url of a source or chunk_id, url and preview of a chunk. A source's title falls back to its URL, then to Untitled; evidence events without chunks are left out."""
    chunk, preview = F.col("type").isin(*CHUNKS), _chunk_preview(events)
    text = lambda c: F.coalesce(_of(events, c), F.lit(""))
    source = F.col("type").isin("search_results", "url_selection", "direct_sources", "refresh_sources")
    shown = events.filter(~chunk | _of(events, "chunk_id").isNotNull() | preview.isNotNull())
    return shown.select(
        "turn_id", "seq", F.row_number().over(Window.partitionBy("turn_id").orderBy("seq")).alias("at"), "type", F.when(F.col("type").isin("plan", *FIELDS), _of(events, "query")).alias("query"),
        F.when(source, F.coalesce(_of(events, "title"), _of(events, "url"), F.lit("Untitled"))).when(chunk, text("title")).alias("title"), F.when(source | chunk, text("url")).alias("url"),
        F.when(chunk, text("chunk_id")).alias("chunk_id"), F.when(chunk, F.coalesce(preview, F.lit(""))).alias("preview"),
    )
