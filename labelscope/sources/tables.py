"""Driver tables (one parquet file or directory per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster when its scan yields fewer
    partitions than the cluster runs tasks at once (e.g. one large parquet
    row group), so row-wise heavy work (regex, JSON) is not done by one task.

    A no-op for large inputs, whose scans already have many splits; call it
    after projecting the needed columns so only those move. With ``key`` the
    rows are hash-distributed on it (deterministic, no local sort).
    """
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave as is
        return df
    if current < target:
        return df.repartition(target, key) if key else df.repartition(target)
    return df
