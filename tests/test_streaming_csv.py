"""Streaming ingestion and CSV -> scoring round trip."""

from labelscope.operators import metrics as M
from labelscope.operators.verdicts import file_verdicts
from labelscope.session import scratch_path
from labelscope.sources import csv_io
from labelscope.streaming.responses import stream_detections

SCHEMA = "request_id string, raw_response string"


def test_stream_appends_and_resumes(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("s_in", "s_out", "s_ckpt"))
    first = spark.createDataFrame([
        ("r1", '{"design_patterns":[{"pattern":"Singleton"},{"pattern":"Observer"}]}'),
        ("r2", "Error: timeout")], SCHEMA)
    first.coalesce(1).write.mode("append").parquet(src)
    stream_detections(spark, src, SCHEMA, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    second = spark.createDataFrame([("r3", "no json here")], SCHEMA)
    second.coalesce(1).write.mode("append").parquet(src)
    # restart from the same checkpoint: only the new file is processed
    stream_detections(spark, src, SCHEMA, out, ckpt).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["request_id"], r["detected_pattern"]) for r in rows) == [
        ("r1", "Observer"), ("r1", "Singleton"), ("r2", "None"), ("r3", "None")]


def test_csv_detections_score_like_the_table(spark):
    from tests.test_scoring_fixture import make_det
    det = make_det(spark)
    path = scratch_path(spark, "det_csv")
    csv_io.write_csv(det.orderBy("row_no").drop("row_no").coalesce(1), path)
    back = csv_io.read_detections_csv(spark, path)
    assert back.count() == det.count()
    a = {r["model_name"]: (r["total_tp"], r["total_fp"], r["total_fn"], r["files_processed"])
         for r in M.micro_scores(file_verdicts(det)).collect()}
    b = {r["model_name"]: (r["total_tp"], r["total_fp"], r["total_fn"], r["files_processed"])
         for r in M.micro_scores(file_verdicts(back)).collect()}
    assert a == b
    # 'None' cells come back missing, as a pandas reader would give them
    assert back.where("detected_pattern IS NULL").count() == 1


def test_csv_columns_matched_by_name(spark):
    path = scratch_path(spark, "det_csv_names")
    df = spark.createDataFrame([(2.5, "m1", "DPD-a.java", "singleton", "Singleton")],
                               "duration_seconds double, model_name string, filename string, "
                               "ground_truth_label string, detected_pattern string")
    csv_io.write_csv(df.coalesce(1), path)
    r = csv_io.read_detections_csv(spark, path).collect()[0]
    assert (r["filename"], r["model_name"], r["duration_seconds"], r["raw_response"]) == \
        ("DPD-a.java", "m1", 2.5, None)
