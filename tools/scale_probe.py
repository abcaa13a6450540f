"""Scoring throughput on a large generated detections table with a hot item.

Usage: python tools/scale_probe.py [rows] [hot_share]
One item (per model) holds ``hot_share`` of all rows; the rest are spread
over many items. Times verdicts + micro scores + label scores + scopes, and
prints rows/second. This is a probe, not a registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from labelscope.operators import metrics as M  # noqa: E402
from labelscope.operators.verdicts import file_verdicts  # noqa: E402
from labelscope.session import get_spark, scratch_path  # noqa: E402

LABELS = ["Singleton", "Factory Method", "observer pattern", "Wrapper", "None", "Strategy"]
GOLDS = ["singleton", "factory", "observer", "decorator"]


def detections(spark, rows: int, hot_share: float):
    hot_every = max(1, round(1 / hot_share)) if hot_share > 0 else 0
    ids = spark.range(0, rows, numPartitions=max(8, rows // 2_000_000))
    item = F.floor(F.col("id") / 4).cast("long")
    hot = (F.col("id") % hot_every == 0) if hot_every else F.lit(False)
    fname = F.when(hot, F.lit("DPD-hot.java")).otherwise(
        F.concat(F.when(item % 2 == 0, F.lit("DPD-")).otherwise(F.lit("PMART-")),
                 item.cast("string"), F.lit(".java")))
    return ids.select(
        fname.alias("filename"),
        F.element_at(F.array(*[F.lit(g) for g in GOLDS]), ((F.xxhash64(fname) % 4 + 4) % 4 + 1).cast("int"))
         .alias("ground_truth_label"),
        F.when(F.col("id") % 3 == 0, F.lit("m1")).when(F.col("id") % 3 == 1, F.lit("m2"))
         .otherwise(F.lit("m3")).alias("model_name"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]),
                     (F.col("id") * 7 % len(LABELS) + 1).cast("int")).alias("detected_pattern"),
        F.lit(1.0).alias("duration_seconds"), F.col("id").alias("row_no"))


def main():
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    hot = float(sys.argv[2]) if len(sys.argv) > 2 else 1 / 3
    spark = get_spark(shuffle_partitions=32)
    det = detections(spark, rows, hot)
    path = scratch_path(spark, "scale_verdicts")
    t0 = time.perf_counter()
    file_verdicts(det).write.parquet(path)          # the one pass over detection rows
    t1 = time.perf_counter()
    v = spark.read.parquet(path)
    for df in (M.micro_scores(v), M.label_scores(v), M.scores_by_scope(v), M.source_accuracy(v)):
        df.write.format("noop").mode("overwrite").save()
    t2 = time.perf_counter()
    hot_rows = v.where("filename = 'DPD-hot.java'").agg(F.sum("n_rows")).first()[0]
    print(json.dumps({"rows": rows, "hot_share": hot, "hot_rows": hot_rows,
                      "verdict_pass_sec": round(t1 - t0, 2), "tables_sec": round(t2 - t1, 2),
                      "rows_per_sec": round(rows / (t2 - t0))}))


if __name__ == "__main__":
    main()
