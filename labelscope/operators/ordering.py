"""Ordered row numbers without a single-partition window.

``row_number() over (order by k)`` with no partition moves every row into
one task. Here rows are range-partitioned and sorted by the order key; each
partition's row count (one small row per partition) gives its offset, and a
window partitioned by the partition id numbers rows inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import scratch_path


def dense_index(df: DataFrame, order_cols: Sequence[str], out_col: str = "row_no",
                start: int = 0) -> DataFrame:
    """Add ``out_col`` = 0-based (plus ``start``) position in ``order_cols`` order.

    Ties keep an arbitrary but fixed order; add a unique column to
    ``order_cols`` for full determinism.
    """
    pid = "__pid"
    # Stored, so that the row counts and the numbering see one and the same
    # partitioning: a second range exchange would draw its own bounds.
    path = scratch_path(df.sparkSession, "ordered")
    (df.repartitionByRange(*order_cols)
       .sortWithinPartitions(*order_cols)
       .withColumn(pid, F.spark_partition_id()).write.parquet(path))
    ordered = df.sparkSession.read.parquet(path)
    counts = ordered.groupBy(pid).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: the running total is computed over a tiny table.
    offsets = counts.select(
        pid, (F.sum("__n").over(Window.orderBy(pid)) - F.col("__n")).alias("__off"))
    w = Window.partitionBy(pid).orderBy(*order_cols)
    return (ordered.join(F.broadcast(offsets), pid)
            .withColumn(out_col, (F.col("__off") + F.row_number().over(w) - 1 + start)
                        .cast("long"))
            .drop(pid, "__off"))
