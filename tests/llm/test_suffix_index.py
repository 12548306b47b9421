import random

from evidencelake.llm import suffix_dedup

from .conftest import docs_of


def test_two_calls_as_one(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, longer = prose(400), prose(1500)
    old = [(1, prose(300) + passage + prose(300)), (2, longer), (3, prose(900))]
    new = [(4, prose(500) + passage + prose(200)), (5, prose(100) + longer[200:1100] + prose(400)), (6, prose(700)), (7, passage)]
    frame = lambda rows: docs_of(spark, [(i, t, "en", "a") for i, t in rows])
    taken = lambda df: {r["doc_id"]: (r["n_removed"], r["kept_sha256"], str(r["spans"])) for r in df.collect()}
    one = taken(suffix_dedup.repeated_spans(frame(old + new), batches=2))
    index = suffix_dedup.IndexFamily()
    first = taken(suffix_dedup.repeated_spans(frame(old), batches=2, index=index))
    second = taken(suffix_dedup.repeated_spans(frame(new), batches=2, index=index))
    assert set(first) == {1, 2, 3} and all(x[0] == 0 for x in first.values())
    assert second == {i: one[i] for i, _ in new}
    assert second[7][0] == 400 and 400 <= second[4][0] < 410 and 900 <= second[5][0] < 910 and second[6][0] == 0  # a byte beside may match by chance
