"""Cases that the registered queries' inputs don't hold."""

from pyspark.sql import functions as F

from labelscope.functions.jsonx import strict_json
from labelscope.operators.metrics import top_ignored
from labelscope.operators.ordering import dense_index
from labelscope.operators.verdicts import file_verdicts


def test_strict_json_needs_the_sentinel_itself(spark):
    texts = ['{"a": 1}', '{"a": 1}, {"x": 1}] and more', '{"a": 1}, 1] tail', '{"a": 1} bye', '[1, 2]']
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.ok for r in d.select("i", strict_json("t").isNotNull().alias("ok")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_dense_index_keeps_wide_rows(spark):
    d = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.repeat(F.lit("x"), 200).alias("content"))
    for parts in ("8", "200"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = dense_index(d, ["k"])
            assert out.filter(F.col("row_no") == F.col("k")).count() == 50_000 == out.count()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def _det(spark, rows):
    return spark.createDataFrame(
        rows, "filename string, ground_truth_label string, model_name string, detected_pattern string, "
              "duration_seconds double, row_no long")


def test_huge_row_numbers_nan_durations_and_null_items(spark):
    det = _det(spark, [("DPD_a.java", "singleton", "m", "singleton", 2.0, 1 << 61),
                       ("DPD_a.java", "singleton", "m", "singleton", float("nan"), (1 << 61) + 1),
                       (None, "singleton", "m", "singleton", 1.0, 0)])
    rows = file_verdicts(det).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.first_row == 1 << 61 and r.gold_label == "singleton" and r.call_duration == 2.0


def test_all_ignored_labels_are_kept(spark):
    hist = spark.createDataFrame([("m", f"l{i}", i + 1, i) for i in range(150)],
                                 "model_name string, raw_label string, n long, first_seen long")
    assert top_ignored(hist, None).count() == 150 and top_ignored(hist).count() == 5
