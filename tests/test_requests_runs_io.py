"""Requests, run tables, CSV round trip, ordering, streaming."""

import datetime as dt

from pyspark.sql import functions as F

from labelscope.operators import runs as RU
from labelscope.operators.ordering import dense_index
from labelscope.operators.requests import accepted_models, build_requests, rejected_models
from labelscope.operators.responses import attach_durations, detection_rows
from labelscope.session import scratch_path
from labelscope.sources import csv_io

MODELS = [
    {"name": "gpt-5", "provider": "openai", "model_id": "gpt-5"},
    {"name": "g", "provider": "google", "model_id": "gemini"},
    {"name": "q", "provider": "groq", "model_id": "llama"},
    {"name": "o", "provider": "OLLAMA", "model_id": "qwen"},
    {"name": "bad", "provider": "nope", "model_id": "x"},
]


def test_requests(spark):
    items = spark.createDataFrame([("DPD-a.java", "singleton", "class A {}")],
                                  "filename string, gold_label string, content string")
    req = {r["model_name"]: r for r in build_requests(items, MODELS, "find patterns").collect()}
    assert set(req) == {"gpt-5", "g", "q", "o"}
    assert req["gpt-5"]["temperature"] == 1.0 and req["o"]["temperature"] == 0.2
    assert req["q"]["max_tokens"] == 1024 and req["g"]["temperature"] is None
    assert [m["role"] for m in req["gpt-5"]["messages"]] == ["system", "user"]
    assert req["g"]["messages"][0]["content"] == \
        "find patterns\n\nSource Code to Analyze:\nclass A {}"
    assert rejected_models(spark, MODELS).collect()[0]["name"] == "bad"
    assert accepted_models(spark, MODELS).count() == 4


def test_detection_rows_join(spark):
    items = spark.createDataFrame([("DPD-a.java", "singleton", "x"), ("PMART-b.java", "factory", "y")],
                                  "filename string, gold_label string, content string")
    items = dense_index(items, ["filename"], "item_no")
    req = build_requests(items, MODELS[:2], "i", keep=("filename", "gold_label", "item_no"))
    t0 = dt.datetime(2025, 1, 1)
    resp = spark.createDataFrame([
        ("gpt-5/DPD-a.java", '{"design_patterns":[{"pattern":"Singleton"}]}', t0,
         t0 + dt.timedelta(seconds=2.5)),
        ("g/DPD-a.java", "Error: quota", t0, t0 + dt.timedelta(seconds=1)),
    ], "request_id string, raw_response string, started_at timestamp_ntz, ended_at timestamp_ntz")
    det = detection_rows(req, resp).collect()
    got = {(r["model_name"], r["filename"]): r for r in det}
    assert got[("gpt-5", "DPD-a.java")]["detected_pattern"] == "Singleton"
    assert got[("gpt-5", "DPD-a.java")]["duration_seconds"] == 2.5
    assert got[("g", "DPD-a.java")]["detected_pattern"] == "None"
    assert got[("gpt-5", "DPD-a.java")]["row_no"] < got[("g", "DPD-a.java")]["row_no"]
    d = attach_durations(resp).collect()
    assert sorted(r["duration_seconds"] for r in d) == [1.0, 2.5]


def test_dense_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = dense_index(df, ["k"], "i").collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(k, k) for k in range(1000)]


def test_csv_roundtrip_keeps_multiline_and_na(spark):
    df = spark.createDataFrame([
        ("a", 'line1\nline2, "quoted"', " padded "), ("b", "None", "N/A"), ("c", None, "")],
        "k string, raw string, v string")
    path = scratch_path(spark, "csvtest")
    csv_io.write_csv(df.coalesce(1), path)
    back = {r["k"]: r for r in csv_io.read_csv(spark, path, "k string, raw string, v string").collect()}
    assert back["a"]["raw"] == 'line1\nline2, "quoted"' and back["a"]["v"] == " padded "
    assert back["b"]["raw"] is None and back["b"]["v"] is None
    assert back["c"]["raw"] is None and back["c"]["v"] is None


def test_runs(spark):
    det = spark.createDataFrame([
        ("DPD-a.java", "m2", 1), ("DPD-a.java", "m1", 5), ("PMART-b.java", "m1", 3),
        ("Q-c.java", "m2", 4)], "filename string, model_name string, row_no long")
    md = RU.run_metadata(det, "src").collect()[0]
    assert (md["files_processed"], md["total_results"], md["dpd_files"], md["pmart_files"]) == \
        (3, 4, 1, 1)
    assert md["models_used"] == ["m2", "m1"]
    rs = RU.run_summary(det).collect()[0]
    assert (rs["rows_loaded"], rs["file_model_groups"], rs["unique_files"]) == (4, 4, 3)
    assert RU.split_by_origin(det).count() == 3
    runs = spark.createDataFrame([("2025-12-09_08-56-29", 370), ("2025-12-11_20-22-44", 251),
                                  ("2025-12-12_00-00-00", 0)], "run_id string, n_rows long")
    lr = RU.latest_run(runs).collect()[0]
    assert lr["run_id"] == "2025-12-11_20-22-44" and lr["n_runs"] == 2
    assert lr["run_started"] == dt.datetime(2025, 12, 11, 20, 22, 44)
    base = scratch_path(spark, "runs")
    RU.write_run(det, base, "2025-12-09_08-56-29")
    parts = spark.read.parquet(base)
    assert {r["origin"] for r in parts.select("origin").distinct().collect()} == \
        {"DPD", "PMART", None}


def test_detector_hook_end_to_end(spark, tmp_path):
    from labelscope.operators.detector import run_detector
    from labelscope.operators.metrics import micro_scores
    from labelscope.operators.verdicts import file_verdicts
    from labelscope.sources.config import load_instruction

    (tmp_path / "prompt.txt").write_text("  detect patterns \n")
    instr = load_instruction(spark, str(tmp_path / "prompt.txt"))
    assert instr == "detect patterns"
    models = spark.createDataFrame(
        [("m1", "ollama", "x"), ("m2", "groq", "y")], "name string, provider string, model_id string")
    items = spark.createDataFrame(
        [("DPD-a.java", "singleton", "class Singleton {}"), ("PMART-b.java", "observer", "x")],
        "filename string, gold_label string, content string")
    items = dense_index(items, ["filename"], "item_no")
    req = build_requests(items, models, instr, keep=("filename", "gold_label", "item_no"))

    def detector(pdf):
        import pandas as pd
        now = pd.Timestamp("2025-01-01")
        text = pdf["messages"].map(lambda ms: ms[-1]["content"])
        resp = text.map(lambda c: '{"design_patterns":[{"pattern":"Singleton"}]}'
                        if "Singleton" in c else "Error: no answer")
        return pd.DataFrame({"request_id": pdf["request_id"], "raw_response": resp,
                             "started_at": now, "ended_at": now + pd.Timedelta(seconds=1)})

    resp = run_detector(req, detector)
    det = detection_rows(req, resp)
    micro = {r["model_name"]: r for r in micro_scores(file_verdicts(det)).collect()}
    assert micro["m1"]["total_tp"] == 1 and micro["m1"]["total_fn"] == 1
    assert micro["m2"]["files_processed"] == 2


def test_run_table_pruning(spark):
    det = spark.createDataFrame([
        ("DPD-a.java", "m1", 1), ("PMART-b.java", "m2", 3)],
        "filename string, model_name string, row_no long")
    base = scratch_path(spark, "runs_pruning")
    RU.write_run(det, base, "2025-01-01_00-00-00")
    q = spark.read.parquet(base).where("origin = 'DPD' AND model_name = 'm1'").select("filename")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(origin" in plan
    assert "PushedFilters: [IsNotNull(model_name), EqualTo(model_name,m1)]" in plan
    assert "ReadSchema: struct<filename:string,model_name:string>" in plan
    assert [r["filename"] for r in q.collect()] == ["DPD-a.java"]


def test_run_metadata_with_items_and_latest_in_folder(spark):
    det = spark.createDataFrame([("DPD-a.java", "m1", 1), ("PMART-b.java", "m1", 2)],
                                "filename string, model_name string, row_no long")
    items = spark.createDataFrame([("DPD-a.java", "x"), ("PMART-b.java", "y"), ("DPD-c.java", None)],
                                  "filename string, content string")
    md = RU.run_metadata(det, "src", items=items).collect()[0]
    assert (md["files_processed"], md["files_read"], md["total_results"]) == (3, 2, 2)
    base = scratch_path(spark, "runs_latest")
    RU.write_run(det, base, "2025-12-09_08-56-29")
    RU.write_run(det.limit(1), base, "2025-12-11_20-22-44")
    lr = RU.latest_run_in(spark, base).collect()[0]
    assert (lr["run_id"], lr["n_rows"], lr["n_runs"]) == ("2025-12-11_20-22-44", 1, 2)


def test_exclude_errors(spark):
    from labelscope.operators.metrics import micro_scores
    from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts
    det = spark.createDataFrame([
        ("DPD-a.java", "singleton", "m", "Singleton", "1", "1", "", "{}", 1.0, 1),
        ("DPD-b.java", "singleton", "m", "None", "0", "0", "", "Error: quota", 1.0, 2)],
        DETECTION_SCHEMA)
    kept = micro_scores(file_verdicts(det)).collect()[0]
    assert (kept["total_tp"], kept["total_fn"]) == (1, 1)
    ex = micro_scores(file_verdicts(det, exclude_errors=True)).collect()[0]
    assert (ex["total_tp"], ex["total_fn"], ex["files_processed"]) == (1, 0, 1)


def test_hot_item_is_pre_aggregated_before_the_shuffle(spark):
    """One item holding a third of all rows: the verdict aggregation is
    partial (map-side) below the exchange, and results stay exact."""
    from labelscope.operators.metrics import confusion_counts
    from labelscope.operators.verdicts import file_verdicts
    n = 30000
    base = spark.range(0, n).select(
        F.when(F.col("id") % 3 == 0, F.lit("DPD-hot.java"))
         .otherwise(F.concat(F.lit("DPD-"), F.col("id").cast("string"), F.lit(".java")))
         .alias("filename"),
        F.lit("singleton").alias("ground_truth_label"), F.lit("m").alias("model_name"),
        F.when(F.col("id") % 2 == 0, F.lit("Singleton")).otherwise(F.lit("Observer"))
         .alias("detected_pattern"),
        F.lit(1.0).alias("duration_seconds"), F.col("id").alias("row_no"))
    v = file_verdicts(base)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")
    hot = v.where("filename = 'DPD-hot.java'").collect()[0]
    assert hot["n_rows"] == n // 3 and hot["detected"] == ["observer", "singleton"]
    counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in confusion_counts(v).collect()}
    assert counts["singleton"][0] + counts["singleton"][2] == 1 + (n - n // 3)


def test_detector_carry_needs_no_join(spark):
    from labelscope.operators.detector import run_detector
    items = spark.createDataFrame([("DPD-a.java", "singleton", "class Singleton {}")],
                                  "filename string, gold_label string, content string")
    items = dense_index(items, ["filename"], "item_no")
    req = build_requests(items, MODELS[:1], "i", keep=("filename", "gold_label", "item_no"))

    def detector(pdf):
        import pandas as pd
        t = pd.Timestamp("2025-01-01")
        return pd.DataFrame({"request_id": pdf["request_id"],
                             "raw_response": '{"design_patterns":[{"pattern":"Singleton"}]}',
                             "started_at": t, "ended_at": t + pd.Timedelta(seconds=3)})

    resp = run_detector(req, detector, carry=("filename", "gold_label", "model_name",
                                              "item_no", "model_no"))
    det = detection_rows(None, resp)
    plan = det._jdf.queryExecution().executedPlan().toString()
    assert not any("Join" in line and "request_id" in line for line in plan.splitlines())
    r = det.collect()[0]
    assert (r["filename"], r["ground_truth_label"], r["detected_pattern"], r["duration_seconds"]) == \
        ("DPD-a.java", "singleton", "Singleton", 3.0)


def test_write_run_is_idempotent(spark):
    det = spark.createDataFrame([("DPD-a.java", "m1", 1), ("PMART-b.java", "m1", 2)],
                                "filename string, model_name string, row_no long")
    base = scratch_path(spark, "runs_idem")
    RU.write_run(det, base, "r1")
    RU.write_run(det, base, "r2")
    RU.write_run(det, base, "r1")   # retried run replaces only its own partitions
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(base).groupBy("run_id").count().collect()}
    assert counts == {"r1": 2, "r2": 2}


def test_scoring_reads_only_needed_columns(spark):
    from labelscope.operators.metrics import micro_scores
    from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts
    det = spark.createDataFrame([
        ("DPD-a.java", "singleton", "m1", "Singleton", "1", "1", "long reasoning", "big text",
         1.0, 1)], DETECTION_SCHEMA)
    path = scratch_path(spark, "det_prune")
    det.write.parquet(path)
    q = micro_scores(file_verdicts(spark.read.parquet(path).where("model_name = 'm1'")))
    plan = q._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema: "):].split("\n")[0]
    assert "raw_response" not in schema and "reasoning" not in schema
    assert "confidence" not in schema
    assert "EqualTo(model_name,m1)" in plan
    assert q.collect()[0]["total_tp"] == 1


def test_config_tables(spark):
    from labelscope.operators.metrics import targets_table
    prov = spark.createDataFrame([("openai", "chat", 0.2, None), ("acme", "joined", None, 64)],
                                 "provider string, message_style string, temperature double, "
                                 "max_tokens int")
    models = [{"name": "a", "provider": "acme", "model_id": "x"}]
    items = spark.createDataFrame([("f.java", "singleton", "c")],
                                  "filename string, gold_label string, content string")
    r = build_requests(items, models, "i", providers=prov).collect()[0]
    assert r["max_tokens"] == 64 and len(r["messages"]) == 1
    t = spark.createDataFrame([("singleton", None), ("factory", None), ("decorator", "PMART")],
                              "label string, scope string")
    assert targets_table(t) == {"ALL": ["factory", "singleton"],
                                "PMART": ["decorator", "factory", "singleton"]}
