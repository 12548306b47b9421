import random
import re

import corpus_pipeline
from evidencelake.llm import jaccard

from .conftest import docs_of

SF = "/root/testdata/sf0.001"


def shingled(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def brute_pairs(texts, least=0.8):
    sets = {i: shingled(t) for i, t in texts.items()}
    ids = sorted(sets)
    alike = lambda x, y: x == y or (4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and len(x & y) / len(x | y) >= least)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(sets[a], sets[b])]


def brute_groups(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(texts):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in texts}


def copies_fixture():
    """Texts of 200 words and copies of them with 1 to 5 words edited, so that similarities lie on both sides of 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, at = {}, 0
    for _ in range(40):
        base = [word() for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 5):
            copy = list(base)
            for k in rng.sample(range(200), edits):
                copy[k] = word()
            texts[at], at = " ".join(copy), at + 1
    return texts


def test_near_stage_finds_edited_copies(spark):
    texts = copies_fixture()
    pairs = brute_pairs(texts)
    assert len(pairs) > 200
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in texts.items()]).repartition(3)
    for most in (jaccard.MOST, 700):  # the second cuts keys into blocks
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs, most=most).collect()}
        found = sum(got[a] == got[b] for a, b in pairs)
        assert found == len(pairs), f"recall {found / len(pairs)}"
        assert got == brute_groups(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SF).select("doc_id").collect()}
    assert kept == set(brute_groups(texts).values())


def test_groups_by_brute_force_on_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(docs).collect()}
    want = brute_groups(texts)
    assert len(set(want.values())) < len(want)
    assert got == want


def test_odd_rows(odd, odd_rows):
    rows = jaccard.near_groups(odd).collect()
    assert len(rows) == len(odd_rows)
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == of[6] == of[7] == 4 and of[8] == of[None] == 8 and of[9] == 9
