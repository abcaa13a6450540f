"""Normalisation (FIXTURES.md section 5), scan and corpus cases."""

import os

from pyspark.sql import functions as F

from labelscope.functions.labels import is_ignored_label, normalize_label
from labelscope.functions.numeric import strict_number
from labelscope.operators import corpus as C
from labelscope.sources.corpus import read_items, scan_files


def test_normalize(spark):
    raws = ["Singleton Pattern", "\tFactory-Method\n", "Decorator", "none", "", None,
            " none ", "Singleton (Potential)", " observer　"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    out = df.select("raw", normalize_label("raw").alias("n3"),
                    normalize_label("raw", targets=("singleton", "factory", "observer",
                                                    "decorator")).alias("n4"))
    out = out.withColumn("ign", is_ignored_label("raw", "n3"))
    got = {r["raw"]: (r["n3"], r["n4"], r["ign"]) for r in out.collect()}
    assert got["Singleton Pattern"][0] == "singleton"
    assert got["\tFactory-Method\n"][0] == "factory"
    assert got["Decorator"] == (None, "decorator", True)
    assert got["none"] == (None, None, False)
    assert got[""] == (None, None, False)
    assert got[None][:2] == (None, None)
    assert got[" none "] == (None, None, True)
    assert got["Singleton (Potential)"][2] is True
    assert got[" observer　"][0] == "observer"


def test_strict_number(spark):
    vals = ["90", " 7.5 ", "1e2", "95%", "12d", "12f", "NaN", "high", "-3", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r["v"]: r["n"] for r in df.select("v", strict_number("v").alias("n")).collect()}
    assert got["90"] == 90.0 and got[" 7.5 "] == 7.5 and got["1e2"] == 100.0
    assert got["-3"] == -3.0 and got[".5"] == 0.5
    for bad in ("95%", "12d", "12f", "NaN", "high"):
        assert got[bad] is None, bad


def test_scan_cases(spark, tmp_path):
    root = tmp_path / "corpus"
    for label, name, data in [
        ("singleton", "X.JAVA", b"class X {}"), ("singleton", "a.b.java", b"class A {}"),
        ("observer", "Foo$.java", b"class Foo {}"), ("factory", "bad.java", b"\x41\x80\x42"),
        ("factory", "crlf.py", b"a\r\nb\rc\n"), ("observer", "same.java", b"one"),
        ("singleton", "same.java", b"two"), ("factory", "notes.txt", b"skip")]:
        os.makedirs(root / label, exist_ok=True)
        (root / label / name).write_bytes(data)
    files = {(r["gold_label"], r["filename"]) for r in scan_files(spark, str(root)).collect()}
    assert ("singleton", "X.JAVA") not in files and ("factory", "notes.txt") not in files
    assert {("singleton", "a.b.java"), ("observer", "Foo$.java"), ("observer", "same.java"),
            ("singleton", "same.java")} <= files
    items = {r["filename"] + "@" + r["gold_label"]: r["content"]
             for r in read_items(spark, str(root)).collect()}
    assert items["bad.java@factory"] == "AB"
    assert items["crlf.py@factory"] == "a\nb\nc\n"
    assert scan_files(spark, str(tmp_path / "missing")).count() == 0
    paths = scan_files(spark, str(root)).select("path")
    stems = {r["filename"]: r["stem"] for r in C.path_labels(paths).collect()}
    assert stems["a.b.java"] == "a.b" and stems["Foo$.java"] == "Foo$"


def test_keyword_priority_and_project(spark):
    df = spark.createDataFrame([
        ("/r/Ant 1.7/src/ObserverFactory.java",), ("/r/JHotDraw/x/WrapperListener.java",),
        ("/r/Antlr2/Plain.java",), ("/r/misc/EventWrapper.java",)], "path string")
    p = C.path_labels(df, extensions=(".java",))
    kl = {r["stem"]: r["label"] for r in C.keyword_labels(p).collect()}
    assert kl == {"ObserverFactory": "factory", "WrapperListener": "observer",
                  "EventWrapper": "decorator"}
    pj = {r["stem"]: (r["project"], r["item_name"])
          for r in C.project_names(p, root="/r").collect()}
    assert pj["ObserverFactory"] == ("Ant", "PMART-Ant-ObserverFactory.java")
    assert pj["Plain"][0] == "Antlr2"
    assert pj["EventWrapper"][0] == "PMARt"
    # the same table through the keyword-table join form
    kw = spark.createDataFrame(
        [(lab, k, i) for i, (lab, ks) in enumerate(
            [("singleton", ["singleton"]), ("factory", ["factory"]),
             ("observer", ["observer", "listener"]), ("decorator", ["decorator", "wrapper"])])
         for k in ks], "label string, keyword string, priority int")
    kj = {r["stem"]: r["label"] for r in C.keyword_labels_join(p, kw).collect()}
    assert kj == kl


def test_sampling_is_partition_independent(spark):
    df = spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    a = {(r["g"], r["k"]) for r in C.stratified_sample(df, "g", "k", n=7).collect()}
    b = {(r["g"], r["k"]) for r in C.stratified_sample(df.repartition(9), "g", "k", n=7).collect()}
    assert a == b and len(a) == 21
    small = df.where("g = 0 and k < 12")   # 4 rows: min(n, size)
    assert C.stratified_sample(small, "g", "k", n=7).count() == 4


def test_dedup_cap_not_used_by_existing(spark):
    rows = [(i, f"n{i % 4}", "t") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, name string, lab string")
    existing = spark.createDataFrame([("t", "n0")], "lab string, name string")
    out = C.dedup_keep_first(df, "lab", "name", "k", n=2, existing=existing).collect()
    names = sorted(r["name"] for r in out)
    assert len(names) == 2 and "n0" not in names and len(set(names)) == 2


def test_corpus_summary_total_row(spark):
    df = spark.createDataFrame([("a", "DPD"), ("a", "PMART"), ("b", "DPD")],
                               "gold_label string, origin string")
    got = {r["gold_label"]: (r["dpd"], r["pmart"], r["total"])
           for r in C.corpus_summary(df).collect()}
    assert got == {"a": (1, 1, 2), "b": (1, 0, 1), "TOTAL": (2, 1, 3)}


def test_py_strip_matches_python(spark):
    from labelscope.functions.text import py_strip
    chars = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "᠎", "x"]
    df = spark.createDataFrame([(c + "a b" + c + c,) for c in chars], "s string")
    got = [r["t"] for r in df.select(py_strip("s").alias("t")).collect()]
    want = [(c + "a b" + c + c).strip() for c in chars]
    assert got == want
