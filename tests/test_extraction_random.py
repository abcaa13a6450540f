"""Responses put together from parts, so that what they yield is known."""

import random

from labelscope.operators.responses import explode_detections, extract_responses

#: Payload -> the labels it yields.
PAYLOADS = [
    ('{"design_patterns":[{"pattern":"Singleton","confidence":90}]}', ["Singleton"]),
    ('{"design_patterns":[{"pattern":"Observer"},{"pattern":"Factory","reason":"x"}]}', ["Observer", "Factory"]),
    ('{"design_patterns":[]}', ["None"]),
    ('{"other":1}', ["None"]),
    ('{"design_patterns":[{"pattern":null}]}', [None]),
    ('{"design_patterns":["s", {"pattern":"B"}]}', ["B"]),
    ('{"a": {"b": 2}}', ["None"]),
]
PLAIN = ["", "Sure. ", "\n", "see ``` this ", "a ] b [ ", "Error - boom "]     # no braces
BROKEN = ["{", "}", "{bad}", "Sure {x", "}{", "123", "null", "[1,2]", '"text"', ""]


def test_composed_responses(spark):
    rng = random.Random(11)
    cases = [(t, ["None"]) for t in BROKEN]
    for payload, labels in PAYLOADS:
        cases.append((payload, labels))                                     # whole
        for _ in range(12):
            before, after = rng.choice(PLAIN), rng.choice(PLAIN)
            cases.append((before + payload + after, labels))                # from brace to brace
            cases.append((before + "```json\n" + payload + "\n```" + after, labels))
        for other, _ in PAYLOADS:                                           # two objects: neither
            cases.append((payload + " " + other, ["None"]))
        # The fence wins over an object outside it, which braces would join to it.
        cases.append(('x {"other":1} ```json ' + payload + "``` y", labels))
        cases.append((payload + "}", ["None"]))
        cases.append((payload + ', {"x":1}] and more', ["None"]))
        cases.append((payload + ", 1] tail", labels))
    df = spark.createDataFrame([(f"r{i:04d}", t) for i, (t, _) in enumerate(cases)],
                               "request_id string, raw_response string")
    got = {}
    for r in explode_detections(extract_responses(df)).orderBy("request_id", "pos").collect():
        got.setdefault(r["request_id"], []).append(r["detected_pattern"])
    for i, (text, labels) in enumerate(cases):
        assert got[f"r{i:04d}"] == labels, repr(text)
