"""From items to scores in one call, and on from where it died."""

import pytest

from labelscope.operators.detection_run import detection_run
from labelscope.operators.metrics import evidence, fp_sample, missed_sample
from labelscope.operators.runs import committed_runs, read_metadata
from labelscope.operators.verdicts import file_verdicts
from labelscope.session import scratch_path

MODELS = [{"name": "m1", "provider": "ollama", "model_id": "x"}, {"name": "m2", "provider": "groq", "model_id": "y"}]
ITEMS = [("DPD-a.java", "singleton", "is a Singleton"), ("DPD-b.java", "factory", "is an Observer"),
         ("PMART-c.java", "observer", "is an Observer"), ("PMART-d.java", "observer", None), ("x.java", "strategy", "is a Singleton")]


def detector(down=()):
    def ask(pdf):
        import pandas as pd
        text = pdf["messages"].map(lambda m: m[-1]["content"].split()[-1])
        if set(text) & set(down):
            raise RuntimeError("the detector is down")
        now = pd.Timestamp("2025-01-01")
        return pd.DataFrame({"request_id": pdf["request_id"], "raw_response": [
            f'{{"design_patterns": [{{"pattern": "{t}"}}]}}' for t in text], "started_at": now, "ended_at": now})
    return ask


def test_run_and_run_again(spark):
    base, run = scratch_path(spark, "run"), "2025-01-01_00-00-00"
    items = spark.createDataFrame(ITEMS, "filename string, gold_label string, content string").repartition(5)
    with pytest.raises(Exception, match="the detector is down"):
        detection_run(items, MODELS, "find", detector(["Observer"]), base, "src", run, waves=4)
    assert committed_runs(spark, base).count() == 0
    out = detection_run(items, MODELS, "find", detector(), base, "src", run, waves=4)
    micro = {r["model_name"]: (r["files_processed"], r["total_tp"], r["total_fp"], r["total_fn"]) for r in out["micro_scores"].collect()}
    assert micro == {"m1": (4, 2, 1, 1), "m2": (4, 2, 1, 1)}
    m = read_metadata(spark, base).first()
    assert (m["files_processed"], m["files_read"], m["total_results"], m["models_used"], m["dpd_files"], m["pmart_files"]) == (
        5, 4, 8, ["m1", "m2"], 2, 1)
    assert spark.read.parquet(f"{base}/answers/{run}").count() == 8
    assert {r["kind"] for r in out["evidence"].collect()} == {"correct", "missed", "false_positive"}


def test_evidence_holds_what_the_counts_count(spark):
    rows = [("a", "singleton", "m", "Singleton", 0), ("a", "singleton", "m", "Factory", 1), ("b", "factory", "m", "None", 2),
            ("c", "observer", "m", "Singleton", 3), ("c", "observer", "m", "Factory", 4), ("d", "strategy", "m", "Factory", 5)]
    det = spark.createDataFrame([(f, g, m, d, "1", "1", "", "", 1.0, n) for f, g, m, d, n in rows],
                                "filename string, ground_truth_label string, model_name string, detected_pattern string, "
                                "confidence string, adherence string, reasoning string, raw_response string, "
                                "duration_seconds double, row_no long")
    v = file_verdicts(det)
    got = {tuple(r) for r in evidence(v).collect()}
    assert got == {("m", "correct", "a", "singleton", "factory,singleton"), ("m", "false_positive", "a", "singleton", "factory"),
                   ("m", "missed", "b", "factory", "none"), ("m", "missed", "c", "observer", "factory,singleton"),
                   ("m", "false_positive", "c", "observer", "factory"), ("m", "false_positive", "c", "observer", "singleton")}
    assert missed_sample(v).count() == 2 and fp_sample(v).count() == 3
