"""Replies of judge and planner models: which JSON in a reply counts, and its fields as columns.

A judge's reply must be JSON from its first brace to its last; a planner's may stand among other
text, where the first object that decodes whole counts. Values that are no strings are written as
Python writes them.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

DECODER = json.JSONDecoder()
TEXTS = ArrayType(StringType())


def first_object(reply: str | None) -> dict | None:
    """The first object of a text that decodes whole, wherever it begins."""
    text = reply or ""
    at = text.find("{")
    while at >= 0:
        try:
            return DECODER.raw_decode(text, at)[0]
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


def whole_json(reply: str | None, fenced: bool = True):
    """The JSON that a reply is, or what stands between its first brace and its last, or else its brackets; ValueError where that does not decode."""
    text = (reply or "").strip()
    if fenced:
        text = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", text)).strip() if text.startswith("```") else text
        try:
            return DECODER.decode(text)
        except (ValueError, RecursionError):
            pass
    for pattern in (r"\{[\s\S]*\}", r"\[[\s\S]*\]")[: 2 if fenced else 1]:
        if found := re.search(pattern, text):
            try:
                return DECODER.decode(found[0])
            except RecursionError as deep:
                raise ValueError from deep
    raise ValueError("no JSON")


def _texts(values, kinds=(str, int, float)) -> list[str]:
    return [t for v in values if isinstance(v, kinds) and (t := str(v).strip())] if isinstance(values, list) else []


PICKS = ArrayType(StructType([StructField("group_index", IntegerType()), StructField("result_indices", ArrayType(IntegerType()))]))


def picks(reply: str | None) -> list[dict] | None:
    """Groups and result indices of a judge's reply; None if it has no JSON or other things in the places of these."""
    try:
        data = whole_json(reply, False)
        small = lambda x: int(x) if isinstance(x, (int, float)) and x == int(x) and abs(x) < 1 << 31 else -1
        return [{"group_index": small(item.get("group_index", 0)), "result_indices": [small(i) for i in item.get("result_indices", [])]} for item in data.get("selected", [])]
    except (ValueError, OverflowError, TypeError, AttributeError):
        return None


#: Fixed word lists, as verdicts depend on them.
NO = ("insufficient", "needs_more", "need_more", "needs more", "not_sufficient", "not sufficient", "no", "not_enough", "not enough", "不夠", "不足")
YES = ("sufficient", "enough", "ok", "complete", "yes", "足夠", "充分")
REVIEW = StructType([StructField("parsed", BooleanType())]).add("ids", TEXTS).add("verdict", StringType()).add("gap_analysis", StringType()).add("answered", TEXTS).add("missing", TEXTS).add("queries", TEXTS).add("search_mode", StringType())


def review(reply: str | None) -> dict:
    """Fields of a reviewer's reply. One that does not parse, is no object or has no known verdict names ids in its text alone and is insufficient."""
    try:
        data = whole_json(reply)
        word = str(data.get("verdict") or "").strip().lower() if isinstance(data, dict) else ""
        if word not in YES and word not in NO:
            raise ValueError("no verdict")
    except ValueError:
        return {"parsed": False, "ids": re.findall(r"L\d+-S\d+-C\d{3}", reply or ""), "verdict": "insufficient", "gap_analysis": "", "answered": [], "missing": [], "queries": [], "search_mode": None}
    named = data.get("selected_chunk_ids") or data.get("chunk_ids") or data.get("selected_ids")
    coverage = data.get("coverage") if isinstance(data.get("coverage"), dict) else {}
    mode = data.get("search_mode")
    return {
        "parsed": True, "ids": [str(x).strip() for x in named] if isinstance(named, list) else [], "verdict": "sufficient" if word in YES else "insufficient", "gap_analysis": str(data.get("gap_analysis", "")).strip(),
        "answered": _texts(coverage.get("answered")), "missing": _texts(coverage.get("missing")), "queries": _texts(data.get("next_search_queries"), str)[:3], "search_mode": (mode.strip().lower() if isinstance(mode, str) else "web") if mode else None,
    }


PLAN = StructType([StructField("strategy", StringType()), StructField("standalone_question", StringType())]).add("queries", TEXTS).add("refresh_refs", TEXTS)


def plan(reply: str | None) -> dict:
    """Fields of the first object in a planner's reply; empty where there is none."""
    data = first_object(reply) or {}
    every = lambda v: [t for x in v if (t := str(x).strip())] if isinstance(v, list) else []
    return {"strategy": str(data.get("strategy") or "research").lower(), "standalone_question": str(data.get("standalone_question") or "").strip(), "queries": every(data.get("queries")), "refresh_refs": every(data.get("refresh_source_refs"))[:2]}


def _udf(read, kind):
    @arrow_udf(kind)
    def run(replies: pa.Array) -> pa.Array:
        return pa.array([read(x) for x in replies.to_pylist()], to_arrow_type(kind))

    return lambda reply: run(F.coalesce(reply, F.lit("")))


picks_of, review_of, plan_of = _udf(picks, PICKS), _udf(review, REVIEW), _udf(plan, PLAN)

