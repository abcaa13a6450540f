"""Run tables: split by origin, run metadata and summary, committed runs.

A run is written in three steps: its rows, by origin, as an attempt of its own;
its metadata as JSON; and last a marker that names the attempt. Readers go by
the markers, so they see a run whole or not at all: what a run that died left
behind is never read, and a repeated run replaces the earlier one only when
its own marker is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import ORIGINS, RUN_ID_FORMAT
from labelscope.functions.labels import origin_of
from labelscope.sources.paths import exists



def new_run_id():
    """Run id of the current time, 'yyyy-MM-dd_HH-mm-ss' (sorts by time)."""
    return F.date_format(F.current_timestamp(), RUN_ID_FORMAT)


def run_started(run_id_col: str = "run_id"):
    return F.to_timestamp_ntz(F.col(run_id_col), F.lit(RUN_ID_FORMAT))


def with_origin(det: DataFrame, origins: Sequence[str] = ORIGINS) -> DataFrame:
    return det.withColumn("origin", origin_of("filename", origins))


def split_by_origin(det: DataFrame, origins: Sequence[str] = ORIGINS) -> DataFrame:
    """Rows of known origins with an ``origin`` column (rows whose name has no
    origin prefix stay in the combined table only)."""
    return with_origin(det, origins).where(F.col("origin").isNotNull())


def write_run(det: DataFrame, base: str, run_id: str, origins: Sequence[str] = ORIGINS) -> str:
    """Write a run's detection rows partitioned by (run_id, origin); an
    origin without rows gets no folder. Only this run's partitions are
    replaced (dynamic partition overwrite), so a retried or repeated job is
    idempotent and other runs are kept. Returns the table path."""
    (with_origin(det, origins).withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "origin").parquet(base))
    return base


# -- committed runs ----------------------------------------------------------------

#: What a marker holds.
MARKER = "run_id string, attempt string, n_rows long"


def write_attempt(det: DataFrame, base: str, run_id: str, origins: Sequence[str] = ORIGINS) -> str:
    """First step of a commit: the rows, partitioned by run, attempt and
    origin. Returns the attempt."""
    attempt = uuid.uuid4().hex
    (with_origin(det, origins).withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
        .write.mode("append").partitionBy("run_id", "attempt", "origin").parquet(f"{base}/rows"))
    return attempt


def _attempt_rows(spark, base: str, run_id: str, attempt: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows/run_id={run_id}/attempt={attempt}")
    # Partition values are read as text, also where they look like something else.
    return rows.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt), "origin": F.col("origin").cast("string")})


def commit_run(det: DataFrame, base: str, run_id: str | None = None, source_dir: str = "",
               origins: Sequence[str] = ORIGINS, items: DataFrame | None = None) -> str:
    """Write a run under ``base`` and commit it: rows, metadata JSON (counted
    over the rows as they were written), marker. ``run_id`` is the current time
    by default (``new_run_id``) and the run's time stamp. A run without rows is
    an error, as it is no result. Returns the run id."""
    spark = det.sparkSession
    run_id = run_id or spark.range(1).select(new_run_id()).first()[0]
    attempt = write_attempt(det, base, run_id, origins)
    if not exists(spark, f"{base}/rows/run_id={run_id}/attempt={attempt}"):
        raise ValueError(f"run {run_id} has no rows")
    rows = _attempt_rows(spark, base, run_id, attempt)
    meta = run_metadata(rows, source_dir, origins, items, timestamp=run_id)
    (meta.withColumn("run_id", F.lit(run_id)).withColumn("attempt", F.lit(attempt))
         .write.mode("overwrite").option("ignoreNullFields", False).json(f"{base}/metadata/{run_id}/{attempt}"))
    marker = spark.createDataFrame([(run_id, attempt, rows.count())], MARKER)
    marker.coalesce(1).write.mode("overwrite").json(f"{base}/committed/{run_id}")
    return run_id


def committed_runs(spark, base: str) -> DataFrame:
    """(run_id, attempt, n_rows) of the runs whose marker is there."""
    if not exists(spark, f"{base}/committed"):
        return spark.createDataFrame([], MARKER)
    return spark.read.schema(MARKER).option("recursiveFileLookup", True).json(f"{base}/committed")


def read_run(spark, base: str, run_id: str | None = None) -> DataFrame:
    """Detection rows of a committed run (default: the latest); only its
    partitions are listed and read."""
    runs = committed_runs(spark, base)
    if run_id is None:
        latest = latest_run(runs).first()
        run_id = latest and latest["run_id"]
    found = runs.where(F.col("run_id") == F.lit(run_id)).first()
    if found is None:
        raise ValueError(f"no committed run {run_id or ''} under {base}")
    return _attempt_rows(spark, base, run_id, found["attempt"])


def read_runs(spark, base: str) -> DataFrame:
    """Detection rows of all committed runs, with run_id and origin. The
    markers prune the attempts (dynamic partition pruning)."""
    runs = committed_runs(spark, base).select("run_id", "attempt")
    # A row for each run.
    rows = spark.read.parquet(f"{base}/rows")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("run_id", "attempt", "origin")})
    return rows.join(runs, ["run_id", "attempt"])


def read_metadata(spark, base: str, origins: Sequence[str] = ORIGINS) -> DataFrame:
    """Metadata of all committed runs: a row for each, models as a list."""
    counts = ", ".join(f"{o.lower()}_files long" for o in origins)
    schema = ("source_dir string, timestamp timestamp_ntz, files_processed long, models_used array<string>, "
              f"total_results long, {counts}, files_read long, run_id string, attempt string")
    runs = committed_runs(spark, base).select("run_id", "attempt")
    if not exists(spark, f"{base}/metadata"):
        return spark.createDataFrame([], schema)
    meta = spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{base}/metadata")
    return meta.join(runs, ["run_id", "attempt"]).drop("attempt")


def _per_file(det: DataFrame) -> DataFrame:
    """(model, file) groups with their row count and first row (partial agg)."""
    return det.groupBy("model_name", "filename").agg(
        F.count(F.lit(1)).alias("__n"), F.min("row_no").alias("__first"))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Combine one-row aggregates side by side without a join."""
    cols = [c for p in parts for c in p.columns]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _files_and_models(det: DataFrame) -> DataFrame:
    """Per-file rows and per-model rows of the (model, file) groups in one
    aggregation (grouping sets), so the detections are read once."""
    return (_per_file(det)
            .groupingSets([["filename"], ["model_name"]], "filename", "model_name")
            .agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__groups"),
                 F.min("__first").alias("__first"),
                 F.grouping("filename").alias("__by_model")))


def _models_in_order(rows: DataFrame):
    """The models as a list, in the order of their first rows."""
    model_rows = F.col("__by_model") == 1
    return F.transform(
        F.array_sort(F.collect_list(F.when(model_rows, F.struct("__first", "model_name")))),
        lambda s: s["model_name"])


def run_metadata(det: DataFrame, source_dir: str, origins: Sequence[str] = ORIGINS,
                 items: DataFrame | None = None, timestamp=None) -> DataFrame:
    """One row: source_dir, files_processed, models_used (a list in first-seen
    order), total_results, and distinct files per origin (``<origin>_files``).

    With ``items`` (the listed corpus, ``content`` NULL when unreadable),
    files_processed counts every listed item and files_read the readable
    ones; otherwise both count the items present in the detections.
    ``timestamp`` (a value or column) adds the run's time stamp."""
    fm = _files_and_models(det).withColumn("origin", origin_of("filename", origins))
    file_rows = F.col("__by_model") == 0
    out = fm.agg(
        F.count_if(file_rows).alias("files_processed"),
        _models_in_order(fm).alias("models_used"),
        F.sum(F.when(file_rows, F.col("__n"))).alias("total_results"),
        *[F.count_if(file_rows & (F.col("origin") == o)).alias(f"{o.lower()}_files")
          for o in origins])
    if items is not None:
        listed = items.agg(F.count(F.lit(1)).alias("__listed"),
                           F.count("content").alias("files_read"))
        out = _one_row(out, listed)
        out = out.withColumn("files_processed", F.col("__listed")).drop("__listed")
    else:
        out = out.withColumn("files_read", F.col("files_processed"))
    cols = [F.lit(source_dir).alias("source_dir")]
    if isinstance(timestamp, str):
        cols.append(F.to_timestamp_ntz(F.lit(timestamp), F.lit(RUN_ID_FORMAT)).alias("timestamp"))
    elif isinstance(timestamp, Column):
        cols.append(timestamp.alias("timestamp"))
    elif timestamp is not None:
        cols.append(F.lit(timestamp).alias("timestamp"))
    return out.select(*cols, "files_processed", "models_used", "total_results",
                      *[f"{o.lower()}_files" for o in origins], "files_read")


def run_summary(det: DataFrame) -> DataFrame:
    """One row: rows_loaded, file_model_groups, unique_files, models (a list)."""
    fm = _files_and_models(det)
    file_rows = F.col("__by_model") == 0
    return fm.agg(
        F.sum(F.when(file_rows, F.col("__n"))).alias("rows_loaded"),
        F.sum(F.when(file_rows, F.col("__groups"))).alias("file_model_groups"),
        F.count_if(file_rows).alias("unique_files"),
        _models_in_order(fm).alias("models"))


def latest_run_in(spark, base: str) -> DataFrame:
    """Latest run of a table written by ``write_run`` (only the partition
    column is read)."""
    return latest_run(runs_table(spark.read.parquet(base).select("run_id")))


def runs_table(rows: DataFrame, run_col: str = "run_id") -> DataFrame:
    """(run_id, n_rows) for every run that holds rows."""
    return rows.groupBy(run_col).agg(F.count(F.lit(1)).alias("n_rows"))


def latest_run(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Latest run (largest id in text order) among runs with rows, as one
    aggregate (no sort): run_id, run_started, n_rows, n_runs."""
    r = runs.where(F.col("n_rows") > 0)
    best = r.agg(F.max_by(F.struct(run_col, "n_rows"), F.col(run_col)).alias("b"),
                 F.count(F.lit(1)).alias("n_runs"))
    return best.select(F.col(f"b.{run_col}").alias("run_id"),
                       F.to_timestamp_ntz(F.col(f"b.{run_col}"), F.lit(RUN_ID_FORMAT))
                        .alias("run_started"),
                       F.col("b.n_rows").alias("n_rows"), "n_runs")
