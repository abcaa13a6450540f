"""Plug-in point for an offline detector.

A detector is a function ``pandas.DataFrame(requests) -> pandas.DataFrame``
with columns (request_id, raw_response, started_at, ended_at). It runs per
partition through ``mapInPandas`` (Arrow batches), so requests are spread
over the cluster and never pass through the driver. ``run_pending`` sends
``BATCH`` of them at once, so that what a worker holds does not grow with its
partition. A failing call should be
returned as an 'Error: ...' response, which scoring counts as a miss.

A run can stop and go on: ``run_pending`` asks only what the response table
does not answer yet and appends, in waves of bounded size that are committed
one by one, so a run that dies loses one wave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import ERROR_PREFIX
from labelscope.sources.paths import exists

RESPONSE_SCHEMA = ("request_id string, raw_response string, "
                   "started_at timestamp_ntz, ended_at timestamp_ntz")

#: Requests that ``run_pending`` gives a detector at once, at most.
BATCH = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

Detector = Callable[["pandas.DataFrame"], "pandas.DataFrame"]  # noqa: F821


def run_detector(requests: DataFrame, detector: Detector,
                 columns: tuple[str, ...] = ("request_id", "model_name", "messages",
                                             "temperature", "max_tokens"),
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Responses of ``detector`` for every request (one output row each).

    ``carry`` names request columns (e.g. filename, gold_label, model_name,
    item_no, model_no) copied onto each response inside the task that made
    it, so the responses need no join back to the requests (see
    ``responses.detection_rows`` with ``requests=None``).
    """
    cols = list(dict.fromkeys([c for c in (*columns, *carry) if c in requests.columns]))
    carried = [c for c in carry if c != "request_id"]
    schema = requests.select(*carried).schema if carried else None
    out_schema = RESPONSE_SCHEMA + "".join(
        f", {f.name} {f.dataType.simpleString()}" for f in (schema.fields if schema else []))

    def apply(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            out = detector(pdf)
            res = pd.DataFrame({
                "request_id": out["request_id"].astype(str),
                "raw_response": out["raw_response"],
                "started_at": pd.to_datetime(out["started_at"]),
                "ended_at": pd.to_datetime(out["ended_at"]),
            })
            if carried:
                res = res.merge(pdf[["request_id", *carried]], on="request_id", how="left")
            yield res

    return requests.select(*cols).mapInPandas(apply, out_schema)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions within it exchange at most ``BATCH`` rows at once with Python."""
    before = spark.conf.get(_BATCH_SETTING)
    limit = int(before)
    spark.conf.set(_BATCH_SETTING, min(limit, BATCH) if limit > 0 else BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def read_answers(spark: SparkSession, path: str, schema: str = RESPONSE_SCHEMA) -> DataFrame:
    """The response table under ``path`` (empty if there is none): one answer
    for each request, the earliest, should two runs at once have asked the
    same."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    w = Window.partitionBy("request_id").orderBy("ended_at", F.xxhash64("raw_response"))
    rows = spark.read.parquet(path)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pending(requests: DataFrame, path: str) -> DataFrame:
    """Requests without an answer under ``path``. Only the ids of the answers
    are read."""
    spark = requests.sparkSession
    if not exists(spark, path):
        return requests
    return requests.join(spark.read.parquet(path).select("request_id"), "request_id", "left_anti")


def run_pending(requests: DataFrame, detector: Detector, path: str, waves: int = 1,
                retry_errors: bool = False, **options) -> DataFrame:
    """Run ``detector`` on the requests that ``path`` has no answer to, append
    the answers and return the whole table (``read_answers``).

    ``waves`` splits the work by a hash of the request id; each wave is one
    committed append, found as answered when the run is started again.
    ``retry_errors`` asks failed calls ('Error: ...') again, and their new
    answers take the old ones' place. Further options go to ``run_detector``."""
    spark = requests.sparkSession
    for wave in range(waves):
        part = requests.where(F.pmod(F.xxhash64("request_id"), F.lit(waves)) == wave) if waves > 1 else requests
        with _small_batches(spark):
            run_detector(pending(part, path), detector, **options).write.mode("append").parquet(path)
    if retry_errors:
        failed = read_answers(spark, path).where(F.col("raw_response").startswith(ERROR_PREFIX)).select("request_id")
        again = run_detector(requests.join(failed, "request_id", "left_semi"), detector, **options)
        with _small_batches(spark):
            again.write.mode("overwrite").parquet(f"{path}.retried")
        return replaced(read_answers(spark, path), spark.read.parquet(f"{path}.retried"))
    return read_answers(spark, path)


def replaced(answers: DataFrame, newer: DataFrame) -> DataFrame:
    """``answers`` with those of ``newer`` in the place of the same request's."""
    return answers.join(newer.select("request_id"), "request_id", "left_anti").unionByName(newer)
