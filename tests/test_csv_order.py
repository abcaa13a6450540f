"""CSV: row order by file name and record, exported row numbers, rejects."""

import os

from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts
from labelscope.sources import csv_io

HEAD = "filename,ground_truth_label,model_name,detected_pattern\n"


def files(folder, **parts):
    os.makedirs(folder)
    for name, body in parts.items():
        (folder / f"{name}.csv").write_text(HEAD + body)
    return str(folder)


def test_order_is_that_of_file_names(spark, tmp_path):
    # The larger file is the second: a scan reads it first.
    path = files(tmp_path / "a", p1="f,singleton,m,x\n", p2="".join(f"f,factory,m,y{i}\n" for i in range(3000)), p3="g,a,m,z\n")
    det = csv_io.read_detections_csv(spark, path)
    assert [r["detected_pattern"] for r in det.orderBy("row_no").collect()] == ["x", *[f"y{i}" for i in range(3000)], "z"]
    assert sorted(r["row_no"] for r in det.collect()) == list(range(3002))
    v = {r["filename"]: r for r in file_verdicts(det).collect()}
    assert v["f"]["gold_label"] == "singleton" and v["f"]["first_row"] == 0


def test_exported_numbers_and_many_files(spark, tmp_path):
    rows = [(f"DPD-{i}", "a", "m", f"say \"{i}\",\nok" if i % 3 else None, "1", "NA", "", "", 1.0, i * 7) for i in range(1000)]
    det = spark.createDataFrame(rows, DETECTION_SCHEMA).repartition(5)
    kept = csv_io.write_detections_csv(det, f"{tmp_path}/kept", max_records=30)
    assert len([f for f in os.listdir(kept) if f.endswith(".csv")]) >= 34
    got = csv_io.read_detections_csv(spark, kept).orderBy("row_no").collect()
    assert [(r["row_no"], r["filename"], r["detected_pattern"], r["adherence"]) for r in got] == [
        (i * 7, f"DPD-{i}", r[3], None) for i, r in enumerate(rows)]
    bare = csv_io.write_detections_csv(det, f"{tmp_path}/bare", export_row_no=False, max_records=30)
    got = csv_io.read_detections_csv(spark, bare).orderBy("row_no").collect()
    assert [(r["row_no"], r["filename"]) for r in got] == [(i, f"DPD-{i}") for i in range(1000)]


def test_records_that_do_not_fit(spark, tmp_path):
    path = files(tmp_path / "b", p1="f,a,m,x\nshort,row\ng,a,m,y\nh,a,m,z,more\n", p2="i,a,m,w\n")
    assert [r["filename"] for r in csv_io.read_detections_csv(spark, path).orderBy("row_no").collect()] == ["f", "g", "i"]
    schema = "filename string, ground_truth_label string, model_name string, detected_pattern string"
    rejects = csv_io.csv_rejects(spark, path, schema).collect()
    assert sorted((r["file"], r["record"].strip()) for r in rejects) == [("p1.csv", "h,a,m,z,more"), ("p1.csv", "short,row")]
    assert csv_io.read_csv(spark, path, schema).count() == 3
    empty = files(tmp_path / "c", p1="")
    assert csv_io.read_detections_csv(spark, empty).count() == 0
