"""Requests and answers: every request keeps its place, the rest is rejected."""

import datetime as dt

from labelscope.operators.metrics import micro_scores
from labelscope.operators.responses import (
    compact_answers, detection_rows, match_answers, matched_rows, rejected_answers,
)
from labelscope.operators.verdicts import file_verdicts
from labelscope.sources.bucketed import write_bucketed

T0 = dt.datetime(2025, 1, 1)
REQUESTS = [(f"m/{i}", f"DPD-{i}.java", "singleton", "m", i, 0) for i in range(6)]
REQUEST_SCHEMA = "request_id string, filename string, gold_label string, model_name string, item_no long, model_no int"
RESPONSE_SCHEMA = "request_id string, raw_response string, started_at timestamp_ntz, ended_at timestamp_ntz"
HIT, MISS = '{"design_patterns":[{"pattern":"Singleton"}]}', '{"design_patterns":[{"pattern":"Observer"}]}'


def tables(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    resp = [("m/0", HIT, T0, at(1)), ("m/1", MISS, T0, at(1)), ("m/1", HIT, at(5), at(9)), ("m/2", "Error: quota", T0, at(1)),
            ("m/9", HIT, T0, at(1)), (None, HIT, T0, at(1)), (None, MISS, T0, at(1)), ("m/3", HIT, T0, None),
            ("m/3", MISS, T0, at(1))]
    return spark.createDataFrame(REQUESTS, REQUEST_SCHEMA), spark.createDataFrame(resp, RESPONSE_SCHEMA)


def test_every_request_has_rows(spark):
    req, resp = tables(spark)
    rows = {r["filename"]: r for r in detection_rows(req, resp).collect()}
    assert len(rows) == 6
    assert [rows[f"DPD-{i}.java"]["response_status"] for i in range(6)] == ["ok", "ok", "error", "ok", "missing", "missing"]
    assert [rows[f"DPD-{i}.java"]["detected_pattern"] for i in range(6)] == [
        "Singleton", "Singleton", "None", "Observer", "None", "None"]
    assert rows["DPD-1.java"]["duration_seconds"] == 4 and rows["DPD-4.java"]["duration_seconds"] is None
    m = micro_scores(file_verdicts(detection_rows(req, resp))).first()
    assert (m["files_processed"], m["total_tp"], m["total_fn"], m["total_fp"]) == (6, 2, 4, 1)
    m = micro_scores(file_verdicts(detection_rows(req, resp), exclude_errors=True)).first()
    assert (m["files_processed"], m["total_tp"], m["total_fn"]) == (3, 2, 1)


def test_rejects(spark):
    req, resp = tables(spark)
    matched = match_answers(req, compact_answers(resp))
    got = sorted((str(r["request_id"]), r["reason"], r["n_detections"]) for r in rejected_answers(matched).collect())
    assert got == [("None", "orphan", 1), ("None", "orphan", 1), ("m/1", "repeated", 1), ("m/3", "repeated", 1),
                   ("m/9", "orphan", 1)]
    none = match_answers(req, compact_answers(resp.limit(0)))
    assert {r["match"] for r in none.collect()} == {"missing"} and matched_rows(none).count() == 6
    assert matched_rows(match_answers(req.limit(0), compact_answers(resp))).count() == 0


def test_no_text_and_no_exchange_in_the_join(spark, tmp_path):
    req, resp = tables(spark)
    resp.write.parquet(f"{tmp_path}/resp")
    answers = compact_answers(spark.read.parquet(f"{tmp_path}/resp"))
    scores = micro_scores(file_verdicts(matched_rows(match_answers(req, answers))))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "raw_response" not in line
    a, b = write_bucketed(req, "request_id", 4), write_bucketed(answers, "request_id", 4)
    joined = match_answers(a, b).select("request_id", "match")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Join"):]
    # Only the (empty here) answers without a request id are dealt anew.
    assert "Bucketed: true" in plan and below.count("Exchange") <= 1
    assert sorted(r["match"] for r in joined.collect()) == sorted(
        ["answered"] * 4 + ["missing"] * 2 + ["repeated"] * 2 + ["orphan"] * 3)


def test_row_numbers_order_items_models_and_elements(spark):
    many = '{"design_patterns":[' + ",".join(['{"pattern":"x"}'] * 5000) + "]}"
    req = spark.createDataFrame([("a", "f", "g", "m1", 0, 0), ("b", "f", "g", "m2", 0, 65_535), ("c", "h", "g", "m1", 1, 0)],
                                REQUEST_SCHEMA)
    resp = spark.createDataFrame([(x, many, T0, T0) for x in "abc"], RESPONSE_SCHEMA)
    rows = [(r["filename"], r["model_name"]) for r in detection_rows(req, resp).orderBy("row_no").collect()]
    assert rows == [("f", "m1")] * 5000 + [("f", "m2")] * 5000 + [("h", "m1")] * 5000
