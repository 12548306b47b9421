import random

from evidencelake import config as C
from evidencelake.functions import querylang as L
from evidencelake.operators import conversations as V
from pyspark.sql import functions as F

KEY = "0123456789abcdef"


def packed(rows, budget):
    """Plain loop over the rows of one group, in order."""
    used, out = 0, []
    for source, chunk, text in sorted(rows, key=lambda r: (r[1], r[0])):
        text, left = text.strip(), budget - used
        if left <= 0:
            break
        if V._est(text) > left:
            text = V._cut(text, max(240, left * 3))
        if text and V._est(text) <= left:
            used += V._est(text)
            out.append((source, chunk, len(out), V._est(text)))
    return out


def test_pack_tokens_by_plain_loop(spark):
    rng = random.Random(2)
    groups = {1: [(0, 0, "a" * 240)] + [(i, 1, "漢" * 400) for i in range(10)] + [(0, 2, "b" * 40)], 2: [], 3: [(0, 0, "漢" * 5000)]}
    groups |= {k: [(rng.randrange(5), i, rng.choice(["x ", "漢"]) * rng.randrange(400)) for i in range(60)] for k in range(4, 12)}
    rows = [(g, s, c, f"c{c}", t) for g, own in groups.items() for s, c, t in own]
    df = spark.createDataFrame(rows, "conv_id long, source_rank long, chunk_rank long, chunk_id string, text string").repartition(5)
    got = {}
    for r in V.pack_tokens(df, ["conv_id"], 100).orderBy("conv_id", "slot").collect():
        got.setdefault(r["conv_id"], []).append((r["source_rank"], r["chunk_rank"], r["slot"], r["tokens"]))
    assert got == {g: p for g, own in groups.items() if (p := packed(own, 100))}
    assert got[1][-1][:2] == (0, 2)  # small enough, behind ten that are not


def test_capsules_hold_what_fits(spark):
    source = lambda k, n, size: (f"T{k}", f"https://a.com/{k}", [(f"C{i + 1}", f"{k}-{i} " + "x" * size) for i in range(n)])
    rows = [("1-t0", "q", ["a", " ", "b", "c", "d"], [source(0, 3, 100), source(1, 40, 4000), source(2, 2, 50)]), ("2-t0", "q", [], [source(0, 1, 400_000)]), ("3-t0", None, ["a"], [])]
    df = spark.createDataFrame(rows, f"turn_id string, standalone_question string, queries array<string>, evidence {V.EVIDENCE}")
    tokens = V.seal_capsules(df, KEY).select(F.split("turn_id", "-")[0].cast("long").alias("conv_id"), F.lit(0).alias("at"), "token")
    assert tokens.count() == 3 and tokens.filter(F.length("token") > 180_000).count() == 0
    got = {r["conv_id"]: r for r in V.unseal_capsules(tokens, KEY).collect()}
    assert set(got) == {1, 2} and got[1]["queries"] == ["a", "b", "c"]
    want = packed([(s, c, t) for s, (_, _, chunks) in enumerate(rows[0][3]) for c, (_, t) in enumerate(chunks)], C.CAPSULE_TOKENS)
    held = [(s["url"], c["chunk_id"]) for s in got[1]["evidence"] for c in s["chunks"]]
    assert sorted(held) == sorted((f"https://a.com/{s}", f"1-t0:C{c + 1}") for s, c, *_ in want)
    assert len(got[2]["evidence"][0]["chunks"][0]["text"]) < 50_000
    assert V.unseal_capsules(tokens.withColumn("token", F.concat(F.lit("x"), "token")), KEY).count() == 0


def test_brave_codes(spark):
    codes = {"ja": "jp", "JA_JP": "jp", "zh-hant": "zh-hant", "zh-TW": "zh-hant", "pt-br": "pt-br", "de-AT": "de", "xx": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in codes], "c string").select("c", L.brave_lang(F.col("c")).alias("b"))
    assert {r["c"]: r["b"] for r in df.collect()} == codes


def test_keywords_by_plain_rules(spark):
    import re

    texts = ["Hello world-wide hello a 漢字 處理ab", "", None, "x yy zz-top 中"]

    def want(t):
        t = (t or "").lower()
        han = "".join(re.findall("[㐀-鿿]", t))
        return list(dict.fromkeys(re.findall(r"[\w-]{2,}", t) + [han[i : i + 2] for i in range(len(han) - 1)]))

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(V.keywords(F.col("t"))).collect()]
    assert got == [want(t) for t in texts]


def test_shrink_history_by_plain_loop(spark):
    rows = [(1, i, i, "assistant" if i % 2 else "user", i > 9, ("t%d " % i) * n) for i, n in enumerate((10, 900, 30, 700, 400, 20, 5, 800, 60, 10, 300))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, at int, role string, full boolean, content string")
    texts = [r[5] for r in rows]
    while sum(map(V._est, texts)) > 1200:
        old = [i for i, t in enumerate(texts) if rows[i][3] == "assistant" and not rows[i][4] and len(t) > 480] or [i for i, t in enumerate(texts) if len(t) > 800]
        shorter = V._cut(texts[old[0]], max(360, len(texts[old[0]]) // 2))
        if len(shorter) >= len(texts[old[0]]):
            break
        texts[old[0]] = shorter
    assert [r["content"] for r in V.shrink_history(df, 1200).orderBy("at").collect()] == texts


def test_tokens_are_opened_once_a_row(spark):
    df = spark.createDataFrame([(1, 0, "x")], "conv_id long, at int, token string")
    plan = V.unseal_capsules(df, KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aesDecrypt") == 1 and plan.lower().count("from_json") + plan.lower().count("jsontostructs") == 1


def test_chunks_without_repeats(spark):
    rows = [("a", "1"), ("a", "2"), ("a", "1"), (None, "1"), (None, None), ("", "1"), ("a", None), ("a", ""), (None, "1"), ("漢:", "x"), ("漢", ":x"), ("a", None)]
    df = spark.createDataFrame([(rows,), (rows[:2],), ([("b", "1"), ("a", "1")],), ([],)], "c array<struct<chunk_id:string,text:string>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(V.distinct_chunks(F.col("c"))).collect()] == [list(dict.fromkeys(rows)), rows[:2], [("b", "1"), ("a", "1")], []]
