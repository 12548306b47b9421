"""Plain searches before patterns rule out nothing that a pattern finds, and give the same counts, lines and repairs."""

import random
import re

import pytest
from evidencelake import config as C
from evidencelake.functions import cleanup
from evidencelake.functions import text as T
from pyspark.sql import functions as F

PATTERNS = {"nav": T.NAV, "leading": C.LEADING_UI, "trailing": C.TRAILING, "ui": C.COMMENT_UI, "item": C.COMMENT_ITEM}
PIECES = (
    "Sign In", "sign\tout", "HOME", "é home", "Cookies", "cookie", "today's epaper", "todays EPAPER", "weather today", "newsletters", "Related  Stories", "you may also\nlike", "all rights reserved", "REPLIES", "reply # 3", "comment12", "留言 4",
    "ความคิดเห็นที่ 7", "下載App", "下載APP", "더 읽기", "续", "İ", "K", "share", "Share", "prose of words", " ", "\xa0", "\r\n", "\x1c", "\x85", " ", "\n", "  ", "\t", "…", "“so”",
)


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(7)
    return [*PIECES, "", *("".join(dice.choice((p, p, " ")) + dice.choice((" ", "\n", "x", "")) for p in dice.choices(PIECES, k=dice.randint(1, 9))) for _ in range(300))]


def test_counts_as_the_pattern_alone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, pattern in PATTERNS.items():
        both = df.select("t", T.count_marks(F.col("t"), pattern).alias("got"), T.count(F.col("t"), pattern).alias("want")).collect()
        assert [r for r in both if r.got != r.want] == [], name
        assert sum(r.got for r in both) > 0


def test_lines_and_blanks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.transform(F.split("t", T.BREAK), T.stripped), lambda x: x != "")
    assert df.filter(T.lines_of(F.col("t")) != plain).count() == 0
    assert df.filter(F.col("t").rlike(r"(?U)[^\S\n ]") & ~F.col("t").rlike(T.ODD_BLANK)).count() == 0


def test_no_mark_no_pattern():
    """Every alternative has a plain word, and each named word is one that its pattern finds."""
    assert {"repl", "comment"} <= set(T.needs(C.COMMENT_UI)) and "cookie" in T.needs(T.NAV) and "epaper" in T.needs(C.LEADING_UI)
    with pytest.raises(ValueError):
        T.needs(r"(?:a|\d+)")


def test_repair_of_spaces(texts):
    for t in (*texts, "a \n \n b", "a \t b", " \n\n\n\n ", "x\t\ny", "Ã©Ã¨Ã " * 3 + "�"):
        want = re.sub(r" *\n *", "\n", re.sub(r"[ \t\f\v]+", " ", t))
        got = re.sub(r"[ \t\f\v]{2,}|[\t\f\v]", " ", t).replace(" \n", "\n").replace("\n ", "\n")
        assert got == want
        assert cleanup._sanitize(t, True, True) == cleanup._sanitize(cleanup._sanitize(t, True, False), True, True)
