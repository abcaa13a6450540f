"""Runs are whole or not there."""

import os

import pytest

from labelscope.operators import runs as RU
from labelscope.operators.detector import pending, read_answers, run_pending
from labelscope.session import scratch_path

SCHEMA = "filename string, model_name string, row_no long"
DET = [("DPD-a", "m2", 1), ("PMART-b", "m1", 2), ("loose", "m1", 3), ("DPD-a", "m1", 4)]


def test_a_run_that_dies_is_not_seen(spark, monkeypatch):
    base = scratch_path(spark, "commit")
    det = spark.createDataFrame(DET, SCHEMA)
    assert RU.committed_runs(spark, base).count() == 0
    with pytest.raises(ValueError):
        RU.read_run(spark, base)
    RU.commit_run(det, base, "2025-01-01_00-00-00", "src")

    def dies(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(RU, "run_metadata", dies)
    with pytest.raises(RuntimeError):                        # a later run: rows are there, no marker
        RU.commit_run(det, base, "2025-01-02_00-00-00", "src")
    with pytest.raises(RuntimeError):                        # the first run again, other rows
        RU.commit_run(det.limit(1), base, "2025-01-01_00-00-00", "src")
    monkeypatch.undo()
    assert [r["run_id"] for r in RU.committed_runs(spark, base).collect()] == ["2025-01-01_00-00-00"]
    assert RU.read_run(spark, base).count() == RU.read_runs(spark, base).count() == 4
    RU.commit_run(det.limit(2), base, "2025-01-02_00-00-00", "src")
    RU.commit_run(det.limit(3), base, "2025-01-01_00-00-00", "src")          # replaced as a whole
    assert RU.read_run(spark, base, "2025-01-01_00-00-00").count() == 3
    assert RU.read_run(spark, base).count() == 2 and RU.read_runs(spark, base).count() == 5


def test_rows_metadata_and_origins(spark):
    base = scratch_path(spark, "commit")
    run = RU.commit_run(spark.createDataFrame(DET, SCHEMA), base, "2025-01-01_10-20-30", "src")
    rows = {(r["filename"], r["model_name"], r["row_no"], r["run_id"], r["origin"]) for r in RU.read_runs(spark, base).collect()}
    assert rows == {("DPD-a", "m2", 1, run, "DPD"), ("PMART-b", "m1", 2, run, "PMART"), ("loose", "m1", 3, run, None),
                    ("DPD-a", "m1", 4, run, "DPD")}
    m = RU.read_metadata(spark, base).first()
    assert (m["models_used"], m["files_processed"], m["total_results"], m["dpd_files"], m["pmart_files"]) == (
        ["m2", "m1"], 3, 4, 1, 1)
    assert str(m["timestamp"]) == "2025-01-01 10:20:30" and m["source_dir"] == "src"
    folder = f"{base}/metadata/{run}".removeprefix("file:")
    text = "".join(open(os.path.join(d, f)).read() for d, _, fs in os.walk(folder) for f in fs if f.endswith(".json"))
    assert '"models_used":["m2","m1"]' in text and '"timestamp":"2025-01-01T10:20:30' in text
    with pytest.raises(ValueError):
        RU.commit_run(spark.createDataFrame([], SCHEMA), base, "2025-02-01_00-00-00")
    now = RU.commit_run(spark.createDataFrame(DET, SCHEMA), base)            # the current time by default
    assert now > run and RU.read_run(spark, base).first()["run_id"] == now


def detector(stamp, fails=()):
    def ask(pdf):
        import pandas as pd
        return pd.DataFrame({"request_id": pdf["request_id"], "raw_response": [
            "Error: down" if r in fails else f"{r} {stamp}" for r in pdf["request_id"]],
            "started_at": pd.Timestamp(stamp), "ended_at": pd.Timestamp(stamp)})
    return ask


def test_detector_goes_on(spark):
    path = scratch_path(spark, "answers")
    req = spark.createDataFrame([(f"r{i}", i) for i in range(50)], "request_id string, n int")
    assert read_answers(spark, path).count() == 0 and pending(req, path).count() == 50
    run_pending(req.where("n < 20"), detector("2025-01-01", {"r3"}), path)
    assert pending(req, path).count() == 30
    got = run_pending(req, detector("2025-01-02"), path, waves=3).collect()
    assert len(got) == 50 == len({r["request_id"] for r in got})
    assert sum("2025-01-01" in r["raw_response"] for r in got) == 19
    got = run_pending(req, detector("2025-01-03"), path).collect()           # nothing left to ask
    assert not any("2025-01-03" in r["raw_response"] for r in got) and len(got) == 50
    got = {r["request_id"]: r["raw_response"] for r in run_pending(
        req, detector("2025-01-04"), path, retry_errors=True).collect()}
    assert got["r3"] == "r3 2025-01-04" and len(got) == 50 and not any("Error" in x for x in got.values())


def test_two_runs_at_once_give_one_answer_each(spark):
    path = scratch_path(spark, "answers")
    req = spark.createDataFrame([(f"r{i}",) for i in range(5)], "request_id string")
    for day in ("2025-01-02", "2025-01-01"):                  # both found nothing answered
        from labelscope.operators.detector import run_detector
        run_detector(req, detector(day)).write.mode("append").parquet(path)
    assert sorted(r["raw_response"] for r in read_answers(spark, path).collect()) == [f"r{i} 2025-01-01" for i in range(5)]
