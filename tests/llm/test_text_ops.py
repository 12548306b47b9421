import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from evidencelake.llm import langid, mixing, packing, quality, secrets, tokens, toxicity
from evidencelake.llm.common import materialize
from pyspark.sql import functions as F

from tests.llm.conftest import docs_of


def test_base_rules_by_brute_force(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = collections.Counter()
    for r in quality.quality_rules(odd, labels).collect():
        got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])] += 1
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(tri)
        covered = {k + d for k, g in enumerate(tri) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(i, len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want
    assert quality.quality_rules(none, labels).count() == 0
    assert all(r["llr"] == 0 for r in quality.quality_rules(odd, labels.filter("quality = 0")).collect())


def test_ratio_rejects_what_the_target_lacks(spark):
    good = [(i, f"the quick fox number {i} and more words here", "en", "a") for i in range(60)]
    junk = [(100 + i, "buy$$$ cheap*** pills### " * 4, "en", "a") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["llr"] for r in quality.quality_rules(docs_of(spark, good + junk), labels).collect()}
    assert min(got[i] for i in range(60)) > quality.THRESHOLD > max(got[100 + i] for i in range(20))


def test_pieces_cover_every_id(odd, none):
    got = packing.harmonic_pack(odd).collect()
    tk = packing._tokenizer(packing.TOKENIZER)
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = np.array(tk.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        by_doc[(p["doc_id"], p["doc_tokens"])].append(p)
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(k[1] * n for k, n in want.items()) == sum(p["length"] for p in got)
    for (doc_id, n, crc), copies in want.items():
        mine = sorted(by_doc[(doc_id, n)], key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) % n == 0 and mine[0]["start"] == 0
        if copies == 1 and len(mine) == 1:
            assert mine[0]["ids_crc32"] == crc
    padding = 0
    for parts in by_seq.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
        padding += 0 if end & (end - 1) == 0 else packing.CAPACITY - end
    assert padding <= packing.CAPACITY * 1.1
    assert packing.harmonic_pack(none).count() == 0


def test_cuts_waste_little():
    for n in range(1, 4096):
        parts = packing.cuts(n)
        assert sum(parts) == n
        assert all(4096 // (4096 // x) - x <= 4096 // (4096 // x) * packing.WASTE or x < 64 for x in parts)


def test_memo_gives_the_tokenizers_ids():
    memo = packing.WordMemo(packing.TOKENIZER, most=30)
    rng = np.random.default_rng(2)
    bits = ["a", "b", " ", "  ", "é", "\n", "the ", "漢", "́", "\xa0", "\x1c", "\x85", "'s", "12", ".", ",", "İ", "Σ", "<|startoftext|>", "text|>", "😀"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.integers(0, 25)))
        assert np.frombuffer(memo.encode(text), "<u4").tolist() == memo.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunked_encoding_is_the_plain_one():
    sp, proven = tokens._model(tokens.MODEL)
    assert proven
    rng = np.random.default_rng(3)
    bits = ["a", "b", " ", "  ", "é", "\n", "the ", "漢", "\t", "▁", "<s>", "ﬁ", "😀"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.integers(0, 600)))
        assert tokens.encode_long(text, chunk=70, overlap=8) == sp.encode(text)
    text = "x" * 4000 + " hello world " * 30
    assert tokens.encode_long(text, chunk=500, overlap=20) == sp.encode(text)


def test_token_counts(odd, none):
    sp, _ = tokens._model(tokens.MODEL)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(odd, chunk=5000).collect())
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in odd.select("doc_id", "text").collect())
    assert got == want and tokens.count_tokens(none).count() == 0


def spans_of(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets_by_brute_force(spark, none):
    rng = np.random.default_rng(5)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", " = ", ":", '"', "'", " ", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "😀", "\n", "deadbeefdeadbeefdeadbeef"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.integers(0, 25))), "en", "a") for i in range(300)] + [(900, None, "en", "a"), (901, "", "en", "a"), (902, "", "en", "a")]
    rows += [(1000 + i, rows[7][1], "en", "a") for i in range(50)]
    df = docs_of(spark, rows)
    want = {i: hashlib.sha256(spans_of(t or "").encode()).hexdigest() for i, t, *_ in rows}
    assert {r["doc_id"]: r["base_sha256"] for r in secrets.secret_report(df).collect()} == want
    assert secrets.secret_report(none).count() == 0
    first = materialize(secrets.scan(df.filter("doc_id < 100")), "t")
    second = secrets.scan(df, first)
    assert first.count() + second.count() == secrets.blobs(df).count()
    assert {r["doc_id"]: r["base_sha256"] for r in secrets.secret_report(df, first).collect()} == want
    changed = (secrets.Rule("hex", "[0-9a-f]{24,}", version=2),)
    assert {tuple(r["rules"]) for r in secrets.scan(df, first.unionByName(second), changed).collect()} == {("hex@2",)}


def test_languages_by_held_out_accuracy(spark, none):
    from pathlib import Path

    docs = spark.read.parquet(str(Path("/root/testdata/sf0.01/documents.parquet")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.fit(docs.filter(~held))
    assert len(model.langs) == 4 and model.code.shape == (4, 7)
    right = langid.predict(docs.filter(held), model).join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert langid.predict(none, model).count() == 0 and langid.fit(none) is None


def test_texts_without_letters_have_no_language(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 11)) and got[10][0] in ("en", "fr")
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (1, 2, 4, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_toxicity_learns_words_and_not_groups(spark, none):
    rng = np.random.default_rng(6)
    words = ["river", "stone", "table", "green", "walk", "music", "paper"]
    groups = ["women", "men", "girls", "boys"]
    rows, marks = [], []
    for i in range(800):
        text, bad = list(rng.choice(words, 12)), i % 4 == 0
        if bad:
            text += ["idiot", "moron"]
        if i % 3 == 0:
            text.append("women" if bad or i % 6 == 0 else groups[i % 4])
        rows.append((i, " ".join(text), "en", "a"))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    plain = {g: model.score(toxicity.text_features(f"river stone {g} walk")) for g in groups}
    assert max(plain.values()) - min(plain.values()) < 0.05 and max(plain.values()) < 0.5
    assert model.score(toxicity.text_features("river idiot moron")) > 0.5
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(docs_of(spark, rows), labels.filter("toxic = 9"))
    assert {r["predicted"] for r in toxicity.score(docs_of(spark, rows[:3]), empty).collect()} <= {0, 1}


def test_toxicity_of_odd_rows(odd):
    model = toxicity.ToxicityModel({}, -1.0)
    assert {round(r["score"], 3) for r in toxicity.score(odd, model).collect()} == {0.269}


@pytest.mark.parametrize("kw", [{}, {"target_entropy": None, "most_repeats": 1.0, "budget_share": 0.9}, {"target_entropy": 0.999, "most_repeats": 3.0, "budget_share": 2.0}])
def test_mix_meets_quotas(odd, odd_rows, none, kw):
    total, longest = collections.Counter(), 0
    for _, t, _, src in odd_rows:
        n = len((t or "").split())
        total[src] += n
        longest = max(longest, n)
    got, weight = collections.Counter(), {}
    for r in mixing.mix_sources(odd, **kw).collect():
        got[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    budget = kw.get("budget_share", 1.0) * sum(total.values())
    for src in total:
        assert -1 <= weight.get(src, 0) * budget - got[src] <= longest + 1
        assert got[src] <= kw.get("most_repeats", 4.0) * total[src] + 1
    assert mixing.mix_sources(none).count() == 0


def test_exponent_is_bisected(spark):
    sizes = [900, 50, 50]
    table = spark.createDataFrame([(t, t / 1000) for t in sizes], "t long, share double")
    at = lambda grid: mixing.moments(table, grid)
    a = mixing.bisect_exponent(at, 1000, 0.8, None)
    assert at([a])[0][1] == pytest.approx(0.8, abs=1e-6)
    b = mixing.bisect_exponent(at, 1000, None, 2.0)
    raised = [(t / 1000) ** b for t in sizes]
    assert max(r / sum(raised) * 1000 / t for r, t in zip(raised, sizes)) == pytest.approx(2.0, abs=1e-6)
    assert mixing.bisect_exponent(at, 1000, 0.1, None) == 1.0 and mixing.bisect_exponent(at, 1000, None, 0.5) == 1.0


def test_even_sources_are_sharpened_to_the_target(spark):
    sizes = [260, 250, 249, 241]
    table = spark.createDataFrame([(t, t / 1000) for t in sizes], "t long, share double")
    at = lambda grid: mixing.moments(table, grid)
    a = mixing.bisect_exponent(at, 1000, 0.97, None, 64.0)
    assert a > 1 and at([a])[0][1] == pytest.approx(0.97, abs=1e-6)
    b = mixing.bisect_exponent(at, 1000, 0.97, 1.2, 64.0)
    raised = [(t / 1000) ** b for t in sizes]
    assert 1 < b < a and max(r / sum(raised) * 1000 / t for r, t in zip(raised, sizes)) == pytest.approx(1.2, abs=1e-6)
    assert mixing.bisect_exponent(at, 1000, 0.97, 1.0, 64.0) == pytest.approx(1.0, abs=1e-9)
    same = spark.createDataFrame([(5, 0.5), (5, 0.5)], "t long, share double")
    assert mixing.bisect_exponent(lambda grid: mixing.moments(same, grid), 10, 0.97, 4.0, 64.0) == 64.0


def test_counts_in_pieces_are_those_of_the_whole(monkeypatch):
    text = "aé b c. Änd so".encode() * 9
    for n in (0, 1, 2, 3, 31, 32, 33, len(text)):
        monkeypatch.setattr(langid, "PIECE", 1 << 20)
        whole = langid.ngram_counts(text[:n])
        for piece in (1, 2, 16, 33):
            monkeypatch.setattr(langid, "PIECE", piece)
            assert (langid.ngram_counts(text[:n]) == whole).all()


def test_very_many_sources(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    plan = mixing.plan_mix(docs, 0.999, 4.0)
    assert plan.count() == 100_000 and plan.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    got = mixing.mix_sources(docs, None, 1.0, 0.5).agg(F.sum("n_tokens"), F.count("*")).first()
    assert 0 < got[0] <= 0.5 * 400_000


def test_ledger_forgets_what_older_rules_found(spark):
    hexes = {1: "x " + "a" * 26, 2: "y " + "b" * 44 + " password=hunter22"}
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in hexes.items()])
    now = lambda ledger, rules: {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs, ledger, rules).collect()}
    one, two = secrets.Rule("hex", "[0-9a-f]{24,}"), secrets.Rule("hex", "[0-9a-f]{40,}", version=2)
    assign = secrets.BASE[0]
    ledger = materialize(secrets.scan(docs, None, (one, assign)), "t")
    assert now(ledger, (one, assign)) == {1: "hex:2:28", 2: "hex:2:46,assign:47:64"}
    assert now(ledger, (two, assign)) == {1: "", 2: "hex:2:46,assign:47:64"}  # a changed rule
    assert now(ledger, (assign,)) == {1: "", 2: "assign:47:64"}  # a dropped one
    again = secrets.findings(docs, ledger, (assign, one)).collect()  # in another order, without a new scan
    assert {r["doc_id"]: [f["rank"] for f in r["findings"]] for r in again} == {1: [1], 2: [1, 0]}
    assert secrets.scan(docs, ledger, (assign, one)).count() == 0


def test_fits_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 20)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 30)
    rows = [(None if i % 2 else 5, f"{'the fox' if i % 3 else 'der hund'} {i % 400}", "en" if i % 3 else "de", "a") for i in range(2000)]
    seen = []
    monkeypatch.setattr(langid, "_train", lambda x, lang, langs: seen.append(np.bincount(lang).tolist()))
    langid.fit(docs_of(spark, rows))
    assert seen == [[20, 20]]
    monkeypatch.setattr(toxicity, "_train", lambda rows, toxic, pairs, times, shift: seen.append((len(rows), len(pairs))))
    terms = "women muslims gay black immigrants old"
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    toxicity.fit(docs_of(spark, [(i, f"{t} {terms}", lang, src) for i, t, lang, src in rows]), labels)
    assert seen[1][0] == 30 and 15 < seen[1][1] < 40
