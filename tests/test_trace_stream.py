import os

from evidencelake.sources.tables import table
from evidencelake.streaming import trace as R
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def events_of(spark):
    return table(spark, SF, "trace").select(F.col("turn_id").cast("long"), F.col("seq").cast("long"), "type", "query", "url", "chunk_id").filter("turn_id < 12 and query <> '' and url <> '' and chunk_id <> ''")


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    events = events_of(spark)
    # later events come first
    events.repartitionByRange(3, F.desc("seq")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(R.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["turn_id"]: tuple(r) for r in R.run_trace_stream(stream, str(tmp_path / "state")).select(*R.trace_state(events).columns).collect()}
    want = {r["turn_id"]: tuple(r) for r in R.trace_state(events).collect()}
    assert got == want and {r[1] for r in want.values()} - {"planning", "evidence"}


def test_state_by_plain_fold(spark):
    states = {}
    for r in events_of(spark).orderBy("turn_id", "seq").collect():
        s = states.setdefault(r["turn_id"], {"stage": "planning", "n": 0, "queries": set(), "items": set()})
        s["n"] += 1
        s["stage"] = R.STAGES.get(r["type"], s["stage"])
        if r["type"] in ("plan", *R.FIELDS):
            s["queries"].add(r["query"])
        field = (R.FIELDS | R.DIRECT).get(r["type"])
        if field:
            s["items"].add((field, r["query"] if r["type"] in R.FIELDS else None, r["chunk_id"] if r["type"] in R.CHUNKS else r["url"]))
    fields = ("sources", "selected_sources", "final_chunks", "direct_sources", "direct_chunks")
    want = {k: (s["stage"], s["n"], len(s["queries"]), *(sum(x[0] == f for x in s["items"]) for f in fields)) for k, s in states.items()}
    got = {r["turn_id"]: (r["stage"], r["n_events"], *(r[c] for c in R.COUNTS)) for r in R.trace_state(events_of(spark)).collect()}
    assert got == want


def test_idle_turns_are_forgotten(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 09:00:00", 2), ("2024-01-01 09:00:01", 2), ("2024-01-01 18:00:00", 1)]
    for i, (t, turn) in enumerate(rows):
        one = spark.createDataFrame([(t, turn, i, "plan", "q", None, None)], f"t string, {R.EVENT}").withColumn("event_time", F.col("t").cast("timestamp")).drop("t")
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{R.EVENT}, event_time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["turn_id"]: r["n_events"] for r in R.run_trace_stream(stream, str(tmp_path / "state")).collect()}
    assert got == {1: 1, 2: 2}


def test_ingest_drops_repeats_across_batches(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1, 0, "https://a.com/x"), ("2024-01-01 00:01:00", 1, 0, "https://A.com/x?utm_a=1"), ("2024-01-01 00:01:00", 1, 1, "https://a.com/x")]
    schema = "ingest_time timestamp, research_id long, query_ordinal long, url string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "t string, research_id long, query_ordinal long, url string").select(F.col("t").cast("timestamp").alias("ingest_time"), "research_id", "query_ordinal", "url").coalesce(1).write.mode("append").parquet(os.fspath(tmp_path / "in"))
    q = R.serp_stream(spark, os.fspath(tmp_path / "in"), schema).writeStream.format("memory").queryName("serp_out").option("checkpointLocation", os.fspath(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("serp_out").count() == 2


def test_what_makes_things_the_same(spark, tmp_path):
    schema = R.EVENT + ", title string, text string, stage string"
    rows = [
        (1, 0, "plan", "", None, None, None, None, None), (1, 1, "search_results", "q", "", None, "T", None, None), (1, 2, "search_results", "q", None, None, "T", None, "own"), (1, 3, "search_results", "q", "u", None, "T", None, None),
        (1, 4, "search_results", "", "u", None, "T", None, None), (1, 5, "search_results", "q", None, None, None, None, None), (1, 6, "direct_evidence", None, "u", None, None, "a  b", None), (1, 7, "direct_evidence", None, "u", "", None, "a b ", None),
        (1, 8, "direct_evidence", None, "v", None, None, "a b", None), (1, 9, "direct_evidence", None, "v", None, None, None, "last"), (2, 0, "other", None, None, None, None, None, None),
    ]
    events = spark.createDataFrame(rows, schema)
    want = [(1, "last", 10, 1, 2, 0, 0, 0, 2), (2, "planning", 1, 0, 0, 0, 0, 0, 0)]
    assert sorted(tuple(r) for r in R.trace_state(events).collect()) == want
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in R.run_trace_stream(stream, str(tmp_path / "state")).collect()) == want
    shown = {(r["turn_id"], r["seq"]): (r["at"], r["title"], r["url"], r["preview"]) for r in R.trace_events(events).collect()}
    assert (1, 9) not in shown and shown[1, 5] == (6, "Untitled", "", None) and shown[1, 3] == (4, "T", "u", None) and shown[1, 6] == (7, "", "u", "a b") and shown[2, 0] == (1, None, None, None)


def test_a_long_turn_keeps_a_small_state(spark, tmp_path):
    spark.range(30_000).selectExpr("1L as turn_id", "id as seq", "'search_results' as type", "'q' as query", "concat('u', id % 20000) as url", "cast(null as string) as chunk_id").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(R.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [tuple(r) for r in R.run_trace_stream(stream, str(tmp_path / "state")).collect()]
    assert got == [(1, "url_judge", 30_000, 1, 20_000, 0, 0, 0, 0)]
    assert "array" not in R.FOLDED and len(R.FOLDED.split(",")) == 4 + len(R.COUNTS)


def test_ledger_after_restarts_and_a_batch_run_again(spark, tmp_path):
    at, schema = str(tmp_path), "research_id long, query_ordinal long, url string, n int"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    take = lambda: sorted(((r["research_id"], r["query_ordinal"], r["url_key"], r["n"]) for r in R.ingest_results(spark.readStream.schema(schema).parquet(f"{at}/in"), at).collect()), key=repr)
    put((1, 0, "https://a.com/x", 2), (1, 0, "https://A.com/x?utm_a=1", 1), (1, 1, "https://a.com/x", 3), (1, 0, "", 4), (None, 0, "https://a.com/x", 5))
    first = [(1, 0, "https://a.com/x", 1), (1, 1, "https://a.com/x", 3), (None, 0, "https://a.com/x", 5)]
    assert take() == first
    put((1, 0, "https://a.com/x#late", 0), (2, 0, "https://b.com/", 6), (None, 0, "https://a.com/x", 7))
    second = sorted([*first, (2, 0, "https://b.com/", 6)], key=repr)
    assert take() == second
    for name in ("1", ".1.crc"):
        os.remove(f"{at}/checkpoint/commits/{name}")  # as if the driver had been lost before the second batch was done
    assert take() == second and take() == second
