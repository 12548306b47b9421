from evidencelake.operators import conversations as V
from evidencelake.operators import jobs
from evidencelake.operators import pages as P
from pyspark.sql import functions as F

SERP = "research_id long, query_ordinal long, source_ordinal int, search_lane string, position int, url string, title string, content string, engine string, published_date string"
PROSE = "This page tells at some length about the matter number %d, so that its text is long enough to be a chunk of its own."


def found(research, query, names, engine="x"):
    return [(research, query, 0, "general", i + 1, f"https://{n}.com/", n, "", engine, None) for i, n in enumerate(names)]


def world(spark):
    """Three sessions: 1 is satisfied in round 1, 2 and 3 are not."""
    serp = spark.createDataFrame([r for k in (1, 2, 3) for r in found(k, 0, [f"a{i}" for i in range(14)])], SERP)
    late = spark.createDataFrame([(k, 0, *r[2:], q) for k in (1, 2, 3) for q, names in (("more", ["b0", "a0"]), ("q (site:reddit.com OR site:news.ycombinator.com OR site:lemmy.world OR site:mastodon.social)", ["s0"])) for r in found(k, 0, names)], SERP + ", query string").drop("query_ordinal")
    names = [f"a{i}" for i in range(14)] + ["b0", "s0", "old"]
    archive = spark.createDataFrame([(k, f"https://{n}.com", n, PROSE % i) for k in (1, 2, 3) for i, n in enumerate(names) if not (k == 3 and n in ("a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8"))], "research_id long, url string, title string, text string")
    questions = spark.createDataFrame([(k, "what of the matter") for k in (1, 2, 3)], "research_id long, question string")
    queries = spark.createDataFrame([(k, 0, "q") for k in (1, 2, 3)], "research_id long, query_ordinal long, query string")
    reply = lambda k: '{"verdict": "%s", "selected_chunk_ids": ["L1-S1-C001"], "next_search_queries": ["more"], "coverage": {"missing": ["numbers"]}}' % ("yes" if k == 1 else "no")
    replies = spark.createDataFrame([(k, 1, reply(k)) for k in (1, 2, 3)], "research_id long, round int, reply string")
    return serp, archive, questions, queries, late, replies


def kept(spark, folder):
    """Rounds written as tables, as a cluster would: without that each round's plan holds all earlier ones."""

    def keep(df, tag):
        path = f"{folder}/{tag}"
        df.coalesce(1).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def hosts(rows, k, round_):
    return {r["url"].split("//")[1].split(".")[0] for r in rows if r["research_id"] == k and r["round"] == round_}


def test_research_rounds(spark, tmp_path):
    serp, archive, questions, queries, late, replies = world(spark)
    full = jobs.research(serp, archive, questions, "full", chunk_replies=replies, queries=queries, later=late, keep=kept(spark, tmp_path / "1")).collect()
    assert hosts(full, 1, 1) == {"a0"} and not hosts(full, 1, 2)  # enough after one round
    assert hosts(full, 2, 1) == {"a0"} and hosts(full, 2, 2) == {"b0"}  # a0 was read; full rounds do not go back to earlier groups
    assert {tuple(r["focus"]) for r in full if r["round"] == 2} == {("numbers",)} and {tuple(r["focus"]) for r in full if r["round"] == 1} == {()}
    fast = jobs.research(serp, archive, questions, "fast", chunk_replies=replies, queries=queries, later=late, keep=kept(spark, tmp_path / "2")).collect()
    second = hosts(fast, 2, 2)
    assert "b0" in second and len(second) > 1 and second <= {"b0", *(f"a{i}" for i in range(4, 14))}  # unread results of round 1 come too
    assert len([1 for r in fast if r["research_id"] == 2 and r["round"] == 1]) == 1


def test_followup_routes(spark):
    source = lambda k: (f"T{k}", f"https://{k}.com/", [("C1", f"{k} tells of rivers")])
    capsules = spark.createDataFrame([(c, at, f"t{at}", "q", ["a"], [source(f"p{at}"), source("both")]) for c in (1, 2, 3, 4) for at in (0, 1)], f"conv_id long, at long, turn_id string, standalone_question string, queries array<string>, evidence {V.EVIDENCE}")
    turns = spark.createDataFrame(
        [(1, "reuse", False, 0, "", 0), (2, "direct", False, 1, "sufficient", 1), (3, "research", False, 0, "", 0), (4, "reuse", True, 0, "", 0), (5, "reuse", False, 0, "", 0)],
        "conv_id long, strategy string, force_research boolean, pages_read int, verdict string, explicit_urls int",
    ).select("*", F.lit("rivers").alias("question"), F.concat(F.lit("n"), "conv_id").alias("turn_id"), F.array(F.lit("x")).alias("queries"))
    kind = "conv_id long, source_order long, title string, url string, chunks array<struct<chunk_id:string,text:string>>"
    direct = spark.createDataFrame([(2, 0, *source("named"))], kind)
    new = spark.createDataFrame([(c, 0, *source("new")) for c in (1, 2, 3, 4)], kind)
    refs = spark.createDataFrame([(3, 0, "t1:S1"), (3, 1, "t9:S1"), (4, 0, "t7:S1")], "conv_id long, ordinal int, source_ref string")
    out = jobs.followup(turns, capsules, refs, direct, new)
    rows = {}
    for r in out.orderBy("conv_id", "source_index").collect():
        rows.setdefault((r["conv_id"], r["route"]), []).append(r["url"] and r["url"].split("//")[1].split(".")[0])
    assert rows[1, "reuse"] == ["p1", "both", "p0"]
    assert rows[2, "direct"] == ["named"]
    assert rows[3, "hybrid"] == ["new", "both", "p0"]  # p1 is read again, so its old evidence goes
    assert rows[4, "research"][0] == "new" and set(rows[4, "research"][1:]) == {"p1", "both", "p0"}
    assert rows[5, "research"] == [None]
    sealed = jobs.seal_turns(out, turns, "0123456789abcdef").select(F.substring("turn_id", 2, 9).cast("long").alias("conv_id"), F.lit(0).alias("at"), "token")
    opened = {r["conv_id"]: [s["url"] for s in r["evidence"]] for r in V.unseal_capsules(sealed, "0123456789abcdef").collect()}
    assert set(opened) == {1, 2, 3, 4} and opened[2] == ["https://named.com/"]


def test_site_probe(spark):
    body = "".join(f"<p>Paragraph {i} tells of river {i * 7} and of sea {i * 11}, and it does so in a whole sentence that is long enough to be prose for any reader.</p>" for i in range(14)) + "<p>Here we saw %s over the bay, and that was all there was to see on this day of the year.</p>"
    html = lambda word, links="": f"<html lang='en'><head><title>A long title of it</title></head><body><article>{body % word}{links}</article></body></html>"
    pages = spark.createDataFrame(
        [(1, "https://a.com/", html("the falcon", '<a href="/two">two</a><a href="https://b.com/x">x</a><a href="/none">n</a><a href="/two#top">t</a>')), (2, "https://a.com/two", html("an Osprey and an osprey")), (3, "https://b.com/x", html("falcon"))],
        "page_id long, url string, html string",
    )
    words = spark.createDataFrame([(0, "osprey"), (1, "falcon")], "ordinal int, keyword string")
    probe = P.site_probe(pages, pages.filter("page_id = 1"), words)
    rows = {r["url_key"]: r for r in probe.collect()}
    assert {u: (r["page_id"], r["ok"]) for u, r in rows.items()} == {"https://a.com/": (1, True), "https://a.com/two": (2, True), "https://a.com/none": (None, False)}
    assert len(rows["https://a.com/"]["snippets"]) == 1 and "falcon" in rows["https://a.com/"]["snippets"][0]
    assert len(rows["https://a.com/two"]["snippets"]) == 2 and "Osprey" in rows["https://a.com/two"]["snippets"][0]
    assert P.probe_stats(probe).collect()[0].asDict() == {"seed_id": 1, "pages_scanned": 2, "pages_failed": 1, "matches_found": 2}
    assert P.site_probe(pages, pages.filter("page_id = 1"), words, 2).count() == 2
    assert P.site_probe(pages.limit(0), pages, words).count() == 0


def test_judge_as_a_function_of_the_prompt(spark):
    rows = [(r, q, k, f"https://h{r}{q}{k}.org/", f"t{k}", "c", "brave", 0.5, None) for r in (1, 2) for q in (0, 1) for k in range(1, 6)]
    serp = spark.createDataFrame(rows, "research_id long, query_ordinal int, rank int, url string, title string, content string, engine string, relevance_score double, published_date string").withColumn("url_key", F.col("url"))
    questions = spark.createDataFrame([(1, "one"), (2, "two")], "research_id long, question string")
    queries = serp.select("research_id", "query_ordinal").distinct().withColumn("query", F.lit("q"))
    # in the prompt are three results of a query: index 4 is none of them; the second session's judge says nothing
    say = lambda p: F.when(p.contains("one") & p.contains("[2]") & ~p.contains("[3]"), '{"selected": [{"group_index": 0, "result_indices": [2, 4]}, {"group_index": 1, "result_indices": [1]}]}')
    seen = serp.limit(0).select("research_id", "url")
    got = jobs.url_selection(serp, None, seen, 1, 2, (3, 4, 5), ask=say, asked=(questions, queries), judged=3)
    urls = {r: {x["url"] for x in got.collect() if x["research_id"] == r} for r in (1, 2)}
    assert urls == {1: {"https://h103.org/", "https://h112.org/"}, 2: {"https://h201.org/", "https://h211.org/"}}
