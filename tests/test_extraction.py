"""Response extraction fixtures (FIXTURES.md section 4)."""

import pytest

from labelscope.operators.responses import (
    explode_detections, extract_responses, rejected_elements,
)

D = '{"design_patterns":[{"pattern":"Singleton","confidence":90,"adherence":80,"reason":"r"}]}'
F3 = "```"
CASES = {
    "x01": (D, ["Singleton"]),
    "x02": ("Sure.\n" + F3 + "json\n" + D + "\n" + F3 + "\nDone {ok}", ["Singleton"]),
    "x03": ("Here it is: " + D + " bye", ["Singleton"]),
    "x04": ('"design_patterns": [{"pattern":"Singleton","confidence":90}]', ["None"]),
    "x05": ('"design_patterns": [{"pattern":"A"},{"pattern":"B"}]', ["None"]),
    "x06": ('{"design_patterns":[]}', ["None"]),
    "x07": ("Error: timeout", ["None"]),
    "x08": ("", ["None"]),
    "x09": (None, ["None"]),
    "x10": ('[{"design_patterns":[]}]', ["None"]),
    "x11": ("123", ["None"]),
    "x12": (F3 + "JSON\n" + D + "\n" + F3, ["Singleton"]),
    "x13": (F3 + "json {bad} " + F3 + " then " + D, ["None"]),
    "x14": (D + " trailing", ["Singleton"]),
    "x15": (D + "] junk", ["Singleton"]),
    "x16": ("{'design_patterns':[{'pattern':'S'}]}", ["None"]),
    "x17": ('{"design patterns":[{"pattern":"Singleton"}]}', ["None"]),
    "x18": ('{"design_patterns":[{"confidence":"95%"}]}', ["Unknown"]),
    "x19": ('{"design_patterns":[{"pattern":null}]}', [None]),
    "x20": ('{"design_patterns":["Singleton"]}', ["None"]),
    "x21": ('{"design_patterns":{"pattern":"Singleton"}}', ["None"]),
    "x22": ('{"design_patterns":[],"design_patterns":[{"pattern":"S"}]}', ["None"]),
    "x23": ('{"design_patterns":[{"pattern":"S","confidence":NaN}]}', ["None"]),
    "x24": ('{"design_patterns":null}', ["None"]),
}
STATUS = {"x07": ("error", "no_json"), "x09": ("null", "null"), "x10": ("ok", "not_object"),
          "x11": ("ok", "not_object"), "x01": ("ok", "ok"), "x06": ("ok", "empty"),
          "x04": ("ok", "no_key"), "x21": ("ok", "not_list"), "x24": ("ok", "empty")}
STEPS = {"x01": "whole", "x02": "fence", "x03": "braces", "x04": "braces", "x05": None,
         "x12": "braces", "x13": None, "x14": "braces", "x15": "braces"}


@pytest.fixture(scope="module")
def resp(spark):
    return spark.createDataFrame([(k, v[0]) for k, v in CASES.items()],
                                 "request_id string, raw_response string")


def grouped(df, col="detected_pattern"):
    out = {}
    for r in df.orderBy("request_id", "pos").collect():
        out.setdefault(r["request_id"], []).append(r[col])
    return out


def test_detections(resp):
    ex = extract_responses(resp)
    got = grouped(explode_detections(ex))
    for k, (_, expected) in CASES.items():
        assert got[k] == expected, k


def test_status_and_steps(resp):
    rows = {r["request_id"]: r for r in extract_responses(resp).collect()}
    for k, (rs, ps) in STATUS.items():
        assert (rows[k]["response_status"], rows[k]["parse_status"]) == (rs, ps), k
    for k, step in STEPS.items():
        assert rows[k]["parse_step"] == step, k


def test_field_defaults(resp):
    rows = {r["request_id"]: r for r in explode_detections(extract_responses(resp)).collect()}
    assert rows["x18"]["confidence"] == "95%"
    assert rows["x01"]["confidence"] == "90" and rows["x01"]["reasoning"] == "r"
    assert rows["x07"]["is_fallback"] and rows["x07"]["confidence"] == "0"
    assert rows["x07"]["reasoning"] == "No pattern detected or parse error"


def test_rejects(resp):
    rej = {(r["request_id"], r["reason"]) for r in rejected_elements(extract_responses(resp)).collect()}
    assert ("x20", "element_not_object") in rej
    assert ("x21", "value_not_list") in rej


def test_options(resp):
    got = grouped(explode_detections(extract_responses(resp, repair_unwrapped=True)))
    assert got["x04"] == ["Singleton"]
    assert got["x05"] == ["A", "B"]
    assert got["x01"] == ["Singleton"]
    keyed = extract_responses(resp, payload_key="design patterns")
    got = grouped(explode_detections(keyed, payload_key="design patterns"))
    assert got["x17"] == ["Singleton"]
