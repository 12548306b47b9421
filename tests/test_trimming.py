"""Trimming by plain rules: the same steps as loops over lines."""

import random
import re

import pytest
from evidencelake import config as C
from evidencelake.functions import text as T
from evidencelake.functions import urls
from evidencelake.operators import trimming as M
from evidencelake.sources import providers as P
from pyspark.sql import functions as F

NAV = T.NAV.replace(r"\b", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


def lines(text):
    return [x.strip() for x in text.splitlines() if x.strip()]


def words(pattern, text, least):
    return len(re.findall(pattern, text)) >= least


def is_shell(x):
    if not x:
        return False
    if re.search(C.FOOTNOTE_LINE, x) or re.search(C.SHELL_LINE, x, re.I) or "另開新視窗" in x or x in "小中大":
        return True
    if len(x) > 18 or re.search("[。！？.!?]|https?://", x):
        return False
    return bool(re.search(NAV, x, re.I)) or ((words("[一-鿿]", x, 2) or words("[A-Za-z]{2,}", x, 1)) and not re.search(r"\d{2,}", x))


def is_prose(x):
    if len(x) < 32 or re.search(C.SHELL_LINE, x, re.I) or re.fullmatch(r"[#\[\](){}<>|/:：\-_=*.\s]+", x):
        return False
    if re.search("https?://", x):
        return len(x) >= 80
    stop = re.search("[。！？.!?；;：:]", x)
    return bool(words("[一-鿿]", x, 16) and (stop or words(C.CONNECTIVE, x, 4)) or words("[A-Za-z]{3,}", x, 10) and stop)


def is_heading(x):
    x = x.lstrip("#").strip()
    return bool(x) and len(x) <= 36 and not re.search("https?://|[。！？.!?]", x) and (words("[一-鿿]", x, 2) or words("[A-Za-z]{2,}", x, 1))


def shell(text):
    all_ = lines(text)
    if len(all_) < 12:
        return text.strip()
    head, body = (all_[:1], all_[1:]) if all_[0].startswith("#") else ([], all_)
    first = next((i for i, x in enumerate(body[:180]) if is_prose(x)), None)
    if sum(map(is_shell, body[:80])) < 6 or first is None:
        return "\n".join(all_)
    at = first
    while at > 0 and first - at < 3 and is_heading(body[at - 1]):
        at -= 1
    return "\n".join(head + (body[at:] if at >= 8 else body))


def sections(text):
    all_ = lines(text)
    if len(all_) < 12:
        return text.strip()
    least = max(4, int(len(all_) * 0.18))
    end = next((i for i, x in enumerate(all_) if i >= least and re.search(C.CUT_LINE, x, re.I)), len(all_))
    return "\n".join(all_[:end])


def places(text, found, reach):
    out = []
    for k, w in enumerate(found):
        at = text.find(w)
        while 0 <= at <= reach:
            out.append((k, at))
            at = text.find(w, at + len(w))
    return out


def part_anchor(text, title):
    text, best = text.strip(), (0, 0)
    name = " ".join(title.split())
    found = list(dict.fromkeys(w for x in [name, *re.split(r"\s*[|｜/\-–—:：]+\s*", name)] if len(w := x.strip(" -|｜/:：")) >= 4))
    for k, p in places(text, found, min(3200, max(900, int(len(text) * 0.45)))):
        n = sum(map(is_shell, lines(text[:p])[-18:]))
        score = p + 140 * n + (80 if len(found[k]) <= 8 else 0) + (180 if n >= 6 else 0)
        best = max(best, (score, p), key=lambda b: b[0]) if p > 0 else best
    return text[best[1] :].lstrip()


def title_anchor(text, title):
    text, best = text.strip(), (0, 0)
    name = " ".join(title.split())
    bases = [name, re.sub(r"\s+\|\s*-\s+.*$", "", name), re.split(r"\s+\|\s+", name, maxsplit=1)[0], re.split(r"\s+-\s+", name, maxsplit=1)[0]]
    bases = list(dict.fromkeys(b for x in bases if len(b := x.rstrip(" -|:;,/")) >= 12))
    found = list(dict.fromkeys(w for b in bases for w in [b, *(b[:n].rstrip(" -|:;,.") for n in (64, 48, 36, 24, 20) if len(b) >= n)] if len(w) >= 12))
    all_ = places(text, found, min(2500, max(600, int(len(text) * 0.35))))
    for k, p in all_:
        if not p:
            continue
        before = lines(text[:p])
        near, short = "\n".join(before[-12:]), sum(len(x) <= 24 for x in before[-8:])
        ui, nav, crumbs = (len(re.findall(r, near, re.I)) for r in (C.LEADING_UI, NAV, r"(?:^|\n)\s*[-|>/]+\s*"))
        score = 240 if p >= 60 else 180 if p >= 8 and (ui + nav + crumbs or short >= 3) else 0
        score += 140 * ui + 120 * nav + 140 * crumbs + min(45 * short, 225) - 160 * text[:p].strip().startswith("#") + 180 * any(a == k and q > p for a, q in all_)
        best = max(best, (score, p), key=lambda b: b[0])
    return text[best[1] :].lstrip()


PROSE = ("This is a long line of prose with quite a few words in it, and it ends here.", "這是一段說明文字，內容在於描述該事件的經過與結果，並將其整理為完整的報導。", "Plain words without an end but long enough to be more than thirty two characters")
SHELL = ("Home", "首頁", "搜尋", "About us", "> News", "[ 12 ]", "^", "小", "Sign in", "Menu", "分享", "Latest 2024")
ENDS = ("相關內容", "延伸閱讀", "外部連結", "地址：台北", "分類")
TITLES = ("A fairly long title of a page | Site - Section", "新聞標題文字 - 網站", "Short", "", "Title of things to come: part two")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [("", ""), (" ", "x"), ("# Head\n" + "\n".join(SHELL * 2) + "\n## Part\n" + PROSE[0], TITLES[0])]
    for _ in range(150):
        title = rng.choice(TITLES)
        parts = [rng.choice(SHELL) for _ in range(rng.randrange(30))] + [title] * rng.randrange(2) + [rng.choice(PROSE + SHELL[:3] + (title, title[:26], "# " + title)) for _ in range(rng.randrange(25))]
        out.append(("\n".join(parts + [rng.choice(ENDS)] * rng.randrange(2) + [rng.choice(PROSE)] * rng.randrange(3)), title))
    return out


@pytest.mark.parametrize("column,plain", [
    (lambda t, _: M.trim_shell(t), lambda t, _: shell(t)), (lambda t, _: M.trim_sections(t), lambda t, _: sections(t)), (M._part_anchor, part_anchor), (M.title_anchor, title_anchor),
], ids=["shell", "sections", "part_anchor", "title_anchor"])
def test_steps_by_plain_rules(spark, texts, column, plain):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(texts)], "i int, t string, n string")
    got = [r[0] for r in df.orderBy("i").select(column(F.col("t"), F.col("n"))).collect()]
    want = [plain(t, n) for t, n in texts]
    assert [x for x in zip(got, want, texts) if x[0] != x[1]][:1] == []
    if any(texts):
        assert got != [t.strip() for t, _ in texts]


def test_clean_content(spark):
    body = "\n".join(PROSE[:2] * 8)
    text = "\n".join(SHELL) + f"\n新聞標題文字\n{body}[ 3 ]\n延伸閱讀\nmore"
    rows = [(text, "新聞標題文字 - 網站", "https://a.com/"), (None, None, None), ("short text", "Some title", "https://zh.wikipedia.org/x")]
    got = [r["text"] for r in M.clean_content(spark.createDataFrame(rows, "text string, title string, url string")).collect()]
    assert got == [f"# 新聞標題文字 - 網站\n\n新聞標題文字\n{body}", "", "# Some title\n\nshort text"]
    pdf = [r[0] for r in spark.createDataFrame([("a\n\n\n\nb", "Some title"), ("# h\nx", "T"), (None, "T")], "t string, n string").select(M.clean_pdf_content(F.col("t"), F.col("n"))).collect()]
    assert pdf == ["# Some title\n\na\n\nb", "# h\nx", ""]


def test_heading_anchor(spark):
    rows = [("x" * 90 + "\n## Part\nbody",), ("y\n# Early",), ("z" * 3000 + "\n# Late",), ("no heading",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(M.heading_anchor(F.col("t"))).collect()]
    assert got == ["## Part\nbody", *(r[0] for r in rows[1:])]


def test_citation_ids_are_encoded(spark):
    rows = [("https://a.com/x y/(b)?q=[1]&z=漢#p(1)",), ("https://a.com/p%20q",), ("https://a.com",), ("doc (1)*",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(urls.citation_id(F.col("u"))).collect()]
    assert got == ["//a.com/x%20y/%28b%29?q=%5B1%5D&z=%E6%BC%A2#p%281%29", "//a.com/p%20q", "//a.com/", "doc%20%281%29%2A"]


def test_declared_providers():
    given = [{"id": "a"}, {"per_query": 500}, {"id": "c", "enabled": False}, {"id": "d", "modes": ["social"]}, {"id": "e", "max_results": -3}]
    assert [(p["id"], p["max_results"]) for p in P.custom_providers(given, "web")] == [("a", 100), ("custom-2", 100), ("e", 1)]
    assert [p["id"] for p in P.custom_providers(given, "social")] == ["a", "custom-2", "d", "e"]
