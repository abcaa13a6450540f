"""A whole scoring run: detection rows -> every result table.

Detection rows are read once, into a row for each item and out-of-scope
spelling (``verdicts.item_labels``), written in the output folder and read
back, and so are the verdicts. That cuts the lineage: every result table is
computed from these two, and a lost executor never forces the detection rows
to be re-shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import DEFAULT_TARGETS, ORIGINS
from labelscope.operators import metrics as M
from labelscope.operators import report as R
from labelscope.operators.verdicts import SynonymsArg, item_labels, verdicts_of


def evaluate(det: DataFrame, out_dir: str, targets: Sequence[str] = DEFAULT_TARGETS,
             synonyms: SynonymsArg = None, origins: Sequence[str] = ORIGINS,
             scopes: Mapping[str, Sequence[str]] | DataFrame | None = None
             ) -> dict[str, DataFrame]:
    """Score ``det`` and write every table under ``out_dir``.

    Returns the tables read back from ``out_dir`` (parquet; the summary also
    as JSON lines). ``scopes`` maps scope names ('ALL' and origins) to target
    lists when they differ, or is a targets table ``(label, scope)``.
    """
    spark: SparkSession = det.sparkSession
    if isinstance(scopes, DataFrame):
        scopes = M.targets_table(scopes)
    all_targets = list(targets)
    if scopes:
        all_targets = sorted({t for ts in scopes.values() for t in ts} | set(targets))
    labels = item_labels(det, synonyms, all_targets, with_scores=True, scored=targets if scopes else None)
    labels.write.mode("overwrite").parquet(f"{out_dir}/item_labels")
    labels = spark.read.parquet(f"{out_dir}/item_labels")
    verdicts_of(labels, all_targets, origins=origins).write.mode("overwrite").parquet(f"{out_dir}/verdicts")
    v = spark.read.parquet(f"{out_dir}/verdicts")
    if scopes:
        v = v.withColumn("gold_label", F.when(F.col("gold_label").isin(*targets),
                                              F.col("gold_label")))
        v = (v.withColumn("detected", F.array_intersect("detected",
                                                         F.array(*[F.lit(t) for t in targets])))
              .withColumn("in_scope", F.col("gold_label").isNotNull())
              .withColumn("correct", F.coalesce(F.array_contains("detected", F.col("gold_label")),
                                                F.lit(False))))
    micro = M.micro_scores(v, targets)
    hist = M.ignored_histogram(labels, all_targets, scored=targets if scopes else None)
    hist.write.mode("overwrite").parquet(f"{out_dir}/histogram")
    hist = spark.read.parquet(f"{out_dir}/histogram")
    tables = {
        "label_scores": M.label_scores(v, targets),
        "micro_scores": micro.drop("first_row"),
        "ignored_top": M.top_ignored(hist),
        "ignored_histogram": hist.select("model_name", "raw_label", "n"),
        "evidence": M.evidence(v),
        "missed_sample": M.missed_sample(v),
        "fp_sample": M.fp_sample(v),
        "score_stats": M.score_stats_from_verdicts(v),
        "duration_stats": M.duration_stats(v),
        "source_accuracy": M.source_accuracy(v),
        "scopes": M.scores_by_scope(spark.read.parquet(f"{out_dir}/verdicts"),
                                    scopes or targets),
        "leaderboard": M.leaderboard(micro),
        "baseline_compare": M.baseline_compare(micro),
    }
    out = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        out[name] = spark.read.parquet(f"{out_dir}/{name}")
    summary = R.summary_table(v, hist, targets)
    R.write_summary_json(summary, f"{out_dir}/summary_json", hist)
    out["summary"] = spark.read.schema(summary.drop("first_row").schema).json(
        f"{out_dir}/summary_json")
    out["verdicts"] = spark.read.parquet(f"{out_dir}/verdicts")
    return out


def evaluate_latest(spark: SparkSession, runs_base: str, out_dir: str,
                    **kwargs) -> dict[str, DataFrame]:
    """Score the latest run (with rows) of a table written by
    ``runs.write_run``; only that run's partitions are read."""
    from labelscope.operators.runs import latest_run_in
    latest = latest_run_in(spark, runs_base).first()
    if latest is None or latest["run_id"] is None:
        raise ValueError(f"no run with rows under {runs_base}")
    det = spark.read.parquet(runs_base).where(F.col("run_id") == latest["run_id"])
    return evaluate(det, out_dir, **kwargs)
