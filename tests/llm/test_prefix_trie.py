"""The trie against plain loops over every prefix of every conversation."""

import hashlib
import random
import zlib

import pytest
from evidencelake.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, seq long, path string, kind string, depth int, n int, base int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "k", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return convs


def with_heads(convs):
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: convs.get(c - c % 100, [])[: h(c)] + turns[h(c) :] for c, turns in convs.items()}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        return [p] + [x for q in kids[p] for x in below(q)]

    out = []
    for p, ids in members.items():
        sub = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ended = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not kids[q] for q in sub), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, n=240):
    rng = random.Random(seed)
    said = lambda d: (rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else ("user", "assistant")[d % 2], rng.choice(["a", "bb", "ccc", "é😀", "", None]) if rng.random() < 0.8 else "x" * rng.randint(1, 9))
    common = [("user", "same"), ("assistant", "again"), ("user", "and")]
    rows = []
    for c in range(n):
        turns = common if c % 3 == 0 else common[:1] + [said(d) for d in range(rng.randint(0, 4))] if c % 3 == 1 else [said(d) for d in range(rng.randint(1, 7))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(1, 0, "user", "same"), (2, None, "user", "first"), (None, 0, "user", "nobody"), (7, 1, None, None), (7, 1, "z", "tie"), (7, 1, "z", "tie")]
    rows += [(501 + i, 0, "user", str(i)) for i in range(6)] + [(-105, 0, "user", "below")]
    rows += [(999, i, "user", "long" + str(i)) for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"run": 7, "fan": 2}, {"run": 1, "fan": 3}, {"run_turns": 20, "fan": 2}])
def test_trie_equals_all_prefixes(spark, sizes):
    rows = some_rows(1)
    got = T.prefix_trie(table(spark, rows), **sizes)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(order(rows))


@pytest.mark.parametrize("sizes", [{}, {"run": 5, "fan": 2}])
def test_rebuilt_conversations(spark, sizes):
    rows = [r for r in some_rows(2) if r[0] is None or r[0] >= 0]
    got = T.prefix_trie(table(spark, rows), T.shared_heads, **sizes)
    convs = with_heads(order(rows))
    assert any(not t for t in convs.values())
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(convs)


def test_copies_of_one_conversation_and_none(spark):
    rows = [(c, i, "user", t) for c in range(150) for i, t in enumerate(("one", "two"))]
    got = T.prefix_trie(table(spark, rows), run=11, fan=2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(order(rows))
    assert T.prefix_trie(table(spark, [])).collect() == []
    assert T.prefix_trie(table(spark, [(None, 0, "user", "x")]), T.shared_heads).collect() == []
