"""Which JSON of a reply counts, and what its fields become."""

import json

import pytest
from evidencelake.functions.replies import first_object, picks, plan, review, whole_json
from evidencelake.operators import judging as J

OBJECTS = [
    ("{bad} {good}", None), ('{bad} {"good": 1}', {"good": 1}), ('{"a": {"b": 2}} {"c": 3}', {"a": {"b": 2}}), ('{"a": {"b": 2} x', {"b": 2}), ('text "{" {"a": "}"}', {"a": "}"}), ('{"a": "\\"{"}', {"a": '"{'}),
    ("```json\n{\"a\": [1, {}]}\n```", {"a": [1, {}]}), ("", None), (None, None), ("[1]", None), ('[{"a": 1}]', {"a": 1}), ("{" * 3000, None),
]


@pytest.mark.parametrize(("reply", "found"), OBJECTS)
def test_first_object(reply, found):
    assert first_object(reply) == found


def test_whole_json():
    assert whole_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert whole_json('so {"a": 1} there') == {"a": 1}
    assert whole_json("see [1, 2]") == [1, 2]
    for broken in ('{"a": 1} see {x}', "", "no", "{x} [1]", '{"a": 1', "{" * 5000):
        with pytest.raises(ValueError):
            whole_json(broken)


def test_reviews():
    full = review(json.dumps({"selected_chunk_ids": ["L1-S1-C001", "nowhere", "L1-S1-C001"], "verdict": "足夠", "coverage": {"answered": ["甲", 1, None, [2]], "missing": "x"}, "next_search_queries": ["一", "二", "三", "四"], "search_mode": "academic", "gap_analysis": 5}))
    assert full == {"parsed": True, "ids": ["L1-S1-C001", "nowhere", "L1-S1-C001"], "verdict": "sufficient", "gap_analysis": "5", "answered": ["甲", "1"], "missing": [], "queries": ["一", "二", "三"], "search_mode": "academic"}
    assert review('{"selected_chunk_ids": [], "chunk_ids": ["b"], "verdict": "NO "}')["ids"] == ["b"]
    for reply in ('{"chunk_ids": ["a"], "verdict": "enough"} see also {x}', '["a"]', '{"chunk_ids": ["a"]}', '{"verdict": "perhaps"}', "5", "", None):
        assert (review(reply)["parsed"], review(reply)["verdict"], review(reply)["ids"]) == (False, "insufficient", [])


def test_picks():
    assert picks('ok {"selected": [{"group_index": 1, "result_indices": [0, 2.0, -1]}, {"result_indices": [1]}]}') == [{"group_index": 1, "result_indices": [0, 2, -1]}, {"group_index": 0, "result_indices": [1]}]
    assert picks('{"other": 1}') == []
    assert [picks(x) for x in ("", None, "[1]", '{"selected": [1]}', '{"selected": []} {x}', '{"selected": [{"result_indices": null}]}')] == [None] * 6


def test_plans(spark):
    assert plan('{not json} then {"strategy":"reuse","queries":["a", 2, null, ""]}') == {"strategy": "reuse", "standalone_question": "", "queries": ["a", "2", "None"], "refresh_refs": []}
    rows = [
        (1, "Q", '{"strategy": "reuse", "queries": ["a"]}', True, False, False, "en"), (2, "Q", '{"strategy": "reuse"}', False, False, False, "en"), (3, "Q", '{"strategy": "direct", "refresh_source_refs": ["t:S1"]}', True, True, False, "en"),
        (4, "Q", '{"strategy": "direct", "queries": ["a", "b", "c", "d"]}', True, True, True, "en"), (5, "問", '{"queries": ["問 深度分析", "x"]}', True, True, False, "zh-TW"), (6, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "research_id long, question string, reply string, multi_turn boolean, has_urls boolean, force_research boolean, language string")
    got = {r["research_id"]: (r["strategy"], r["queries"], r["refresh_refs"]) for r in J.parse_plans(df).collect()}
    assert got[1] == ("reuse", [], []) and got[3] == ("direct", [], [])
    assert got[2] == ("research", ["Q", "Q latest information", "Q in-depth analysis"], [])
    assert got[4] == ("research", ["a", "b", "c"], [])
    assert got[5] == ("research", ["問 深度分析", "x", "問 觀點 3"], [])
    assert got[6][0] == "research" and len(got[6][1]) == 3
