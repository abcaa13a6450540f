"""Findings of round four: collections of many files, whose names the driver doesn't hold."""

import os
import zlib

from pyspark.sql import functions as F

from labelscope.operators import corpus as C
from labelscope.sources import corpus as S


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_driver_holds_no_file_names_of_a_collection(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "_MOST_MET", 50, raising=False)     # so that folders are left to a second round
    items = spark.range(600).select(F.concat(F.lit("l"), F.col("id") % 3).alias("gold_label"),
                                    F.concat(F.lit("p-Observer"), "id", F.lit(".java")).alias("filename"),
                                    F.concat(F.lit("text "), "id").alias("content"))
    root = S.write_items(items, f"{tmp_path}/many")
    files = S.scan_files(spark, root, (".java",), layout="folder")
    texts = S.read_texts(spark, root, (".java",), layout="folder")
    # A file index keeps the name and state of every file in the driver's memory.
    assert all(len(df.inputFiles()) < 300 for df in (files, texts))
    assert {(r["gold_label"], r["filename"]) for r in files.collect()} == {(f"l{i % 3}", f"p-Observer{i}.java") for i in range(600)}
    assert files.count() == 600 and {r["content"] for r in texts.collect()} == {f"text {i}\n" for i in range(600)}
    # The texts are not taken for a small table, which the driver would collect to broadcast it.
    corpus = C.build_corpus([C.tree_collection(files, n=1000)], [texts], f"{tmp_path}/corpus")
    assert corpus.where("content is not null").count() == 600
    plan = S.read_items(spark, root, layout="folder")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tasks_find_and_read_what_spark_does(spark, tmp_path, monkeypatch):
    z = b"z" * 1000
    sums = b"crc\0\0\0\2\0" + b"".join(zlib.crc32(z[i:i + 512]).to_bytes(4, "big") for i in (0, 512))
    for name in ("a/b.java", "a/.h.java", "a/_u.java", "a/_u=1.java", "_hid/x.java", "_k=v/x.java", ".dot/x.java", "_metadata/x.java",
                 "q._COPYING_/x.java", "a/s p%20+é[1]{x}*?.java", "a/co:lon.java", "x.JAVA", "x.java/in.java", "a/d/e/f/g.py"):
        put(tmp_path / name, b"caf\xe9\r\nx")
    put(tmp_path / "a" / "empty.java", b"")
    put(tmp_path / "a" / os.fsdecode(b"bad\xff.java"), b"x")
    for i, crc in enumerate((sums, sums[:12], sums[:8], sums[:-1] + b"x", sums + b"junk12", b"", b"crx" + sums[3:], b"crc\0\0\0\0\0abcd")):
        put(tmp_path / "c" / f"{i}.java", z)
        put(tmp_path / "c" / f".{i}.java.crc", crc)
    for link, to in (("link.java", "b.java"), ("broken.java", "nowhere"), ("self.java", "self.java"), ("folder", "../x.java")):
        os.symlink(to, tmp_path / "a" / link)
    reads = [lambda f=f, root=root: rows(f(spark, root, (".java", ".py")))
             for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/a/b.java", f"{tmp_path}/a/.h.java")
             for f in (S.scan_files, S.read_items, S.read_texts)]
    got = [r() for r in reads]
    monkeypatch.setattr(S, "_MOST_MET", 2)
    assert [r() for r in reads[:3]] == got[:3]
    monkeypatch.setattr(S, "mounted", lambda *_: None)         # as in another store: Spark lists and reads
    assert [r() for r in reads] == got
    assert len(got[0]) == 18 and len(got[2]) == 12
