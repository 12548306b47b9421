from evidencelake.functions import text as T
from evidencelake.operators import chunks as K
from evidencelake.operators import pages as P
from evidencelake.operators import trimming as M
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens_of_mixed_text(spark):
    assert [one(spark, t, T.est_tokens) for t in ("", "abcde", "漢字ab", None)] == [0, 2, 3, 0]


def test_paragraphs_drop_short_and_repeated(spark):
    long_ = "Word " * 30
    assert one(spark, f"{long_}\n\nshort\n\n{long_.upper()}\n\n{'other ' * 20}", lambda c: F.size(K.dedupe_paragraphs(K.paragraphs(c)))) == 2


def test_overlong_paragraph_is_split_at_sentences(spark):
    got = one(spark, "A sentence of some length here. " * 100, K.split_long)
    assert all(len(x) <= 1400 for x in got) and " ".join(got) == ("A sentence of some length here. " * 100).strip()
    assert [len(x) for x in one(spark, "x" * 3000, K.split_long)] == [1400, 1400, 200]


def test_pdf_lines_are_packed_by_page(spark):
    text = "## 第 1 頁\n" + "line of text\n" * 200 + "## 第 2 頁\n" + "tail"
    got = one(spark, text, K.pdf_paragraphs)
    assert all(len(x) <= 905 for x in got[:-1]) and got[-1].endswith("tail")


def test_smart_truncate_prefers_sentence_ends(spark):
    assert one(spark, "One. " * 100, lambda c: T.smart_truncate(c, 203)) == ("One. " * 40).strip()


def test_low_value_pages(spark):
    assert [one(spark, t, T.low_value_reason) for t in ("", "Just a moment", "ok then", "This is a fine page of text.")] == ["EMPTY_CONTENT", "BLOCKER_ANTI_BOT", "LOW_INFO_CONTENT", None]


def test_kwic_marks_cut_ends(spark):
    assert one(spark, "a" * 50 + "Key" + "b" * 50, lambda c: P.kwic(c, F.lit("key"), 5, 3)) == ["...aaaaaKeybbbbb..."]


def test_chunk_ids_are_floored(spark):
    assert spark.range(1).select(T.chunk_id(F.lit(0), F.lit(0), F.lit(7))).first()[0] == "L1-S1-C007"


def test_trimming_cuts_shells(spark):
    body = "This is the first full sentence of the page. " * 3
    text = f"Sign in\nHome > News\n{body}\nMiddle line of the text here.\nLast sentence stands here.\nShort note\nRead more\nOther"
    assert one(spark, text, M.trim_leading).startswith("Home > News\nThis is")
    assert one(spark, text, M.trim_trailing).endswith("Last sentence stands here.")
    assert one(spark, "a line", lambda c: M.title_heading(c, F.lit("A title of some length"))) == "# A title of some length\n\na line"


def test_navigation_marks_are_counted(spark):
    import re

    texts = ["Home | About us | SIGN  IN\nresearch homes searching", "首頁 關於 Cookies cookie terms term", "nothing of that", "", "x" * 3998 + " home", "ſign in Ⓗome MENU-menu"]
    plain = [len(re.findall(T.NAV.replace(r"\b", r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"), t[:4000], re.I | re.A)) for t in texts]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.nav_hits(F.col("t"))).collect()]
    assert got[:5] == plain[:5] == [3, 5, 0, 0, 0] and got[5] == 2


def test_language_class_by_counts(spark):
    texts = ["", "abc", "漢" * 16, "漢" * 15 + "a" * 28, "漢" * 15 + "a" * 30, "漢" * 9 + "a" * 2, "漢" * 8, "ก" * 16, "ก" * 15, "ก" * 20 + "あ" * 16]
    assert [one(spark, t, T.language_class) for t in texts] == ["latin", "latin", "cjk", "cjk", "latin", "cjk", "latin", "thai", "latin", "cjk"]
