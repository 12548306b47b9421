"""Text repair that has no built-in: NFKC, HTML entities, mojibake and byte decoding, in Arrow batches.

Rows that cannot change (plain ASCII without ``&``) never reach Python: what goes there is null for
them, because a condition around a UDF does not keep rows from it.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

CHARSETS = ("utf-8", "utf-8-sig", "big5", "cp950", "gb18030", "gbk", "shift_jis", "euc-jp", "cp1252", "latin-1")
#: What UTF-8 read as a one-byte charset looks like.
GARBLED = re.compile("[Â-ô][\x80-¿€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œ]|�")
UNTOUCHED = "^[\\t\\n\\x20-\\x25\\x27-\\x7E]*$"


def _odd_class() -> re.Pattern:
    """Private, unassigned, control and half-width characters as one class of ranges."""
    odd = [n for n in range(0x110000) if (unicodedata.category(chr(n)) in ("Co", "Cn", "Cc") and n not in (9, 10, 13)) or 0xFF61 <= n <= 0xFF9F]
    starts = [n for n, before in zip(odd, [-2, *odd]) if n != before + 1]
    ends = [n for n, after in zip(odd, [*odd[1:], -2]) if n != after - 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


ODD = functools.cache(_odd_class)


def oddness(text: str) -> float:
    """How unlike written text a decoding looks: garbled sequences, private, control and half-width characters, by length."""
    odd = 6 * len(GARBLED.findall(text)) + 12 * text.count("�")
    if not text.isascii() or not text.isprintable():
        odd += 4 * len(ODD().findall(text))
    return odd / max(1, len(text))


def repair(text: str, rounds: int = 2) -> str:
    """UTF-8 that was read as a one-byte charset, read right, if that is clearly better; up to twice."""
    for _ in range(rounds):
        if not GARBLED.search(text):
            break
        found = []
        for charset in ("latin-1", "cp1252"):
            try:
                found.append(text.encode(charset).decode("utf-8"))
            except UnicodeError:
                continue
        best = min(found, key=oddness, default=text)
        if oddness(best) >= oddness(text):
            break
        text = best
    return text


def decode(body: bytes | None, content_type: str | None = "") -> str:
    """Text of a page's bytes: the declared charset and the usual ones compete, strict decodings only; the least odd wins, earlier on ties."""
    if not body:
        return ""
    declared = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.IGNORECASE)
    out = []
    for charset in dict.fromkeys(([declared[1]] if declared else []) + list(CHARSETS)):
        try:
            out.append(repair(body.decode(charset)))
        except (UnicodeError, LookupError):
            continue
        if oddness(out[-1]) == 0:  # no later one is less odd, and earlier ones are odder
            return out[-1]
    return min(out, key=oddness, default=body.decode("utf-8", errors="replace"))


def garbled_line(line: str) -> bool:
    if line.isascii():
        return False
    # characters are looked at one by one only where they decide
    return line.count("�") >= 2 or (len(GARBLED.findall(line)) >= 3 and sum(c.isalpha() or c.isdecimal() for c in line) < max(10, int(len(line) * 0.45)))


def _sanitize(text: str, newlines: bool, drop_garbled: bool) -> str:
    text = html.unescape(html.unescape(repair(text.replace("\r\n", "\n").replace("\r", "\n"))))
    text = re.sub("[​-‏⁠﻿]", "", text)
    text = unicodedata.normalize("NFKC", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ", text))
    if not newlines:
        return " ".join(text.split())
    # a space alone stays, and most lines have none at their ends
    text = re.sub(r"[ \t\f\v]{2,}|[\t\f\v]", " ", text).replace(" \n", "\n").replace("\n ", "\n")
    if drop_garbled:
        text = "\n".join(x for x in text.splitlines() if not garbled_line(x))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def in_parts(values: pa.Array, read, kind: pa.DataType, rows: int = 256) -> pa.Array:
    """``read`` of each value, a few rows at a time: no more of a batch than these stands in Python objects at once."""
    made = [pa.array([read(x) for x in values.slice(at, rows).to_pylist()], kind) for at in range(0, len(values), rows)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def sanitize(df: DataFrame, col: str, newlines: bool = True, drop_garbled: bool = True) -> DataFrame:
    """df with ``col`` repaired and normalised; ASCII rows take the built-in way and go as nulls past Python, so that df is read once."""

    @arrow_udf("string")
    def fix(texts: pa.Array) -> pa.Array:
        return in_parts(texts, lambda t: None if t is None else _sanitize(t, newlines, drop_garbled), pa.string())

    c = F.coalesce(F.col(col), F.lit(""))
    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), " *\\n *", "\n"), "\\n{3,}", "\n\n") if newlines else F.regexp_replace(c, "\\s+", " ")
    return df.withColumn(col, F.coalesce(fix(F.when(~c.rlike(UNTOUCHED), c)), F.regexp_replace(squeezed, "^\\s+|\\s+$", "")))


def drop_garbled_lines(text: Column) -> Column:
    """Lines that look like undecoded bytes go, by built-in functions alone."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    odd = lambda x: F.regexp_count(x, F.lit(GARBLED.pattern))
    natural = lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{Nd}]"))
    bad = lambda x: (F.regexp_count(x, F.lit("�")) >= 2) | ((odd(x) >= 3) & (natural(x) < F.greatest(F.lit(10), F.floor(F.length(x) * 0.45))))
    return F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")


def decode_body(df: DataFrame, body: str = "body", content_type: str = "content_type", decoder=None) -> DataFrame:
    """df with text decoded from bytes; a caller's pandas UDF of (bytes, content type) may take the place of the decoder."""

    @pandas_udf("string")
    def own(b: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([decode(x, k) for x, k in zip(b, kind)])

    return df.withColumn("text", (decoder or own)(F.col(body), F.col(content_type)))
