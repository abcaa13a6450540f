"""Corpus build from two collections of files; unreadable files; errors of the root."""

import os

import pytest
from pyspark.sql import functions as F

from labelscope.operators import corpus as C
from labelscope.operators.runs import run_metadata
from labelscope.sources.corpus import read_items, read_texts, scan_files, write_items


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_build_from_files(spark, tmp_path):
    one = put(tmp_path / "one", **{f"p-C{i}_dot_java": f"class C{i}" for i in range(8)})
    two = put(tmp_path / "two", **{"Ant 1__x__ObserverA_dot_java": "oa", "JHotDraw__y__ObserverA_dot_java": "ob",
                                   "misc__ObserverA_dot_java": "oc", "misc__deep__ObserverA_dot_java": "od",
                                   "misc__MyFactory_dot_java": b"caf\xe9\r\nx", "misc__Plain_dot_java": "no",
                                   "misc__Singleton_dot_txt": "no"})
    index = spark.createDataFrame([("Factory", "p", f"C{i}") for i in range(12)] + [("None", "p", "C1"), ("Observer", "p", "C2")],
                                  "raw_label string, Project string, Class string")
    listed = [scan_files(spark, r, (".java",)) for r in (one, two)]
    texts = [read_texts(spark, r, (".java",)) for r in (one, two)]
    out = f"{tmp_path}/corpus"
    got = C.build_corpus([C.index_collection(index, listed[0], n=100), C.tree_collection(listed[1], n=100)], texts, out)
    rows = {(r["gold_label"], r["filename"]): r["content"] for r in got.collect()}
    assert {k for k in rows if k[1].startswith("DPD")} == {("factory", f"DPD-p-C{i}.java") for i in range(8)} | {
        ("observer", "DPD-p-C2.java")}
    assert rows["factory", "PMART-PMARt-MyFactory.java"] == "caf\nx" and rows["observer", "PMART-Ant-ObserverA.java"] == "oa"
    # Equal names in one label: one of them stays.
    assert rows["observer", "PMART-PMARt-ObserverA.java"] in ("oc", "od") and len(rows) == 13
    # A smaller build, of one label: all of the earlier one goes, or only that label.
    few = C.index_collection(index.where("raw_label = 'Factory' and Class < 'C2'"), listed[0], n=100)
    assert C.build_corpus([few], texts, out, clear=False).groupBy("gold_label").count().orderBy("gold_label").collect() == [
        ("factory", 2), ("observer", 4)]
    assert C.build_corpus([few], texts, out).count() == 2


def test_unreadable_files_are_counted(spark, tmp_path):
    root = put(tmp_path / "r", **{"a__DPD-1_dot_java": "short", "a__DPD-2_dot_java": "long " * 100, "b__DPD-3_dot_java": "x",
                                 "b__DPD-4_dot_java": "damaged", "b___dot_DPD-4_dot_java_dot_crc": b"crc\0\0\0\2\0\1\2\3\4"})
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")           # longer files can't be read
    try:
        items = read_items(spark, root)
        got = {r["filename"]: r["content"] for r in items.collect()}
        assert got == {"DPD-1.java": "short", "DPD-2.java": None, "DPD-3.java": "x", "DPD-4.java": None}
        det = spark.createDataFrame([("DPD-1.java", "m", 1), ("DPD-3.java", "m", 2)], "filename string, model_name string, row_no long")
        m = run_metadata(det, "src", items=items).first()
        assert (m["files_processed"], m["files_read"]) == (4, 2)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_missing_root_is_empty_and_other_errors_are_raised(spark, tmp_path):
    for read in (scan_files, read_items, read_texts):
        assert read(spark, f"{tmp_path}/none").count() == 0
        with pytest.raises(Exception, match="nosuchstore"):
            read(spark, "nosuchstore://bucket/x")
    with pytest.raises(ValueError):
        scan_files(spark, str(tmp_path), layout="zip")


def test_folders_of_items(spark, tmp_path):
    items = spark.createDataFrame([("en", "Ant 1.7", "A+b%.java", "t\r\nu"), ("e=n", "x/y", "Plain.txt", "v")],
                                  "gold_label string, project string, filename string, content string")
    root = write_items(items, f"{tmp_path}/w", label_cols=("project", "gold_label"))
    got = read_items(spark, root, (".java", ".txt"), layout="folder").select(
        "below", "filename", "gold_label", "content", F.length("path") > 0).collect()
    assert {tuple(r)[:4] for r in got} == {("/Ant 1.7/en/A+b%.java", "A+b%.java", "en", "t\nu\n"),
                                           ("/x/y/e=n/Plain.txt", "Plain.txt", "e=n", "v\n")}
