import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from evidencelake.llm import exact_dedup, simhash, suffix_dedup
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_exact_groups_by_brute_force(odd, odd_rows, monkeypatch):
    for salt in (256, 2):
        monkeypatch.setattr(exact_dedup, "SALT_ROWS", salt)
        got = exact_dedup.exact_dedup(odd).collect()
        groups = defaultdict(list)
        for i, t, *_ in odd_rows:
            groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0))
        want = sorted((hashlib.sha256(k.encode()).digest(), len(g), None if min(g)[1] else min(g)[2]) for k, g in groups.items() for _ in g)
        assert sorted((bytes(r["digest"]), r["group_size"], r["keep_id"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_compares_whole_texts(odd, monkeypatch):
    class Weak:
        def __init__(self, raw):
            self.raw = raw

        def digest(self):
            return bytes([len(self.raw) % 3])

    monkeypatch.setattr(exact_dedup.hashlib, "sha256", Weak)
    b = exact_dedup._combine_locally(type("B", (), {"value": {}}))
    assert b  # digests that collide must not merge texts: checked on the streaming step itself
    import pyarrow as pa

    ddl = dict(x.split() for x in exact_dedup.LOCAL.split(", "))
    rows = [(0, 10, 1, b"d", 0, 0, b"aa"), (1, 11, 1, b"d", 0, 1, b"bb"), (2, 12, 1, b"d", 0, 0, None)]
    batch = pa.record_batch({n: pa.array([r[i] for r in rows], exact_dedup._ARROW[k]) for i, (n, k) in enumerate(ddl.items())})
    out = pa.Table.from_batches(list(exact_dedup._merge_salts(type("B", (), {"value": {}}))(iter([batch])))).to_pylist()
    assert {(r["doc_id"], r["keep_id"], r["size"]) for r in out} == {(10, 10, 2), (12, 10, 2), (11, 11, 1)}


def want_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_by_brute_force(odd_rows):
    for _, t, *_ in odd_rows:
        assert simhash.fingerprint((t or "").encode()) == want_fp(t)


def test_links_and_components_by_brute_force(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(12):  # chains of one- and two-bit steps
        x = rng.choice(sorted(fps))
        for _ in range(8):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64).tolist()
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    edges = simhash.links(nodes)
    assert {(r["a"], r["b"]) for r in edges.collect()} == want
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    linked = {x for p in want for x in p}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


def test_golay_keys_meet_for_one_error():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    keys, n = simhash.golay_keys(x)
    for bit in range(23):
        near, _ = simhash.golay_keys(x ^ (1 << bit))
        assert all(near[i, 0] in keys[i, : n[i]] for i in range(len(x)))


def test_simhash_groups_of_odd_rows(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == odd.count() and simhash.simhash_groups(none).count() == 0
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == by[4] == 4


def brute_spans(rows, length):
    seen = defaultdict(int)
    for _, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] += 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_repeated_spans_by_brute_force(spark, none, batches):
    rng = random.Random(batches)
    make = lambda n: "".join(rng.choice("abcdé漢\n ") for _ in range(n))
    base = [make(1200) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "a" * 900), (3, "ab" * 450), (4, make(399))]
    for i in range(5, 30):
        b, p = rng.choice(base), rng.randint(0, 700)
        text = make(rng.randint(0, 200)) + b[p : p + rng.randint(100, 900)] + make(rng.randint(0, 100))
        if i % 4 == 0:
            text = text[: len(text) // 2] + "Z" + text[len(text) // 2 :]
        rows.append((i, text))
    rows += [(20, rows[20][1]), (None, rows[21][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, uid string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_spans(df, batches).collect())
    assert got == brute_spans(rows, suffix_dedup.LENGTH)
    if batches == 1:
        assert suffix_dedup.repeated_spans(none).count() == 0


def test_levels_merge_geometrically(spark):
    family = suffix_dedup.IndexFamily()
    level = lambda *keys: spark.createDataFrame([(0, k, k, 1, 0, 0, 0) for k in keys], "unit int, key long, cover long, uid long, at int, lo int, hi int")
    sizes = []
    for k in range(5):
        family.add(level(k, 100))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]
    assert family.levels[0][1].filter("key = 100").count() == 4
    found = family.add(level(100, 7, 8, 8))
    assert sorted(r[0] for r in found.collect()) == [8, 100]
    assert family.matches(found).count() == 8


def brute_passages(rows, length):
    where = defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - length + 1):
            where[b" ".join(w[k : k + length])].add((i, t))
    shared = {x for docs in where.values() if len(docs) > 1 for x in docs}
    return {str(i): (i, t) in shared for i, t in rows}


def test_shared_passages_by_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "of", "it", "漢", "den", "é"]
    make = lambda n: [rng.choice(words) + rng.choice(["", "", "x", "y"]) for _ in range(n)]
    base = [make(160) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a " * 300), (3, " ".join(make(49)))]
    for i in range(4, 60):
        b, p, n = rng.choice(base), rng.randint(0, 90), rng.choice([20, 40, 48, 49, 50, 51, 60, 90])
        space = "\n" if i % 3 else "  "
        rows.append((i, space.join(make(rng.randint(0, 80)) + b[p : p + n] + make(rng.randint(0, 80)))))
    rows += [(60, rows[30][1]), rows[31]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {str(r["doc_id"]): r["shares_passage"] for r in suffix_dedup.repeated_spans(df).collect()}
    want = brute_passages(rows, suffix_dedup.WORDS.length)
    assert got == want and 5 < sum(want.values()) < 55


def test_very_long_text_is_worked_through_in_pieces(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdefgh     ", k=n))
    long = prose(suffix_dedup.PIECE + 200_000)
    across = long[suffix_dedup.PIECE - 700 : suffix_dedup.PIECE + 800]
    rows = [(1, long), (2, prose(500) + "Q" + across + "R" + prose(300)), (3, "x" * 3000), (4, prose(1000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["shares_passage"]) for r in suffix_dedup.repeated_spans(df, 1).collect()}
    assert got == {1: (1500, 1, True), 2: (1500, 1, True), 3: (3000, 1, False), 4: (0, 0, False)}


def test_many_copies_in_one_partition_are_dealt_over_salts(spark):
    n = 20_000
    digest = hashlib.sha256(b"same").digest()
    step = exact_dedup._combine_locally(type("B", (), {"value": {digest: -(-n // exact_dedup.SALT_ROWS)}}))
    docs = spark.range(n).selectExpr("id as doc_id", "cast('same ' as string) as text").coalesce(1)
    rows = docs.selectExpr("doc_id", "cast(5 as bigint) as n_chars", "cast(text as binary) as text").mapInArrow(step, exact_dedup.LOCAL)
    groups = rows.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.count("body").alias("bodies")).collect()
    assert sum(r["n"] for r in groups) == n and max(r["n"] for r in groups) == exact_dedup.SALT_ROWS and {r["bodies"] for r in groups} == {1}
    got = exact_dedup.exact_dedup(docs).groupBy("keep_id", "group_size").agg(F.count("*"), F.count_if("kept")).collect()
    assert [tuple(r) for r in got] == [(0, n, n, 1)]
