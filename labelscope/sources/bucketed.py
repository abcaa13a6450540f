"""Tables bucketed by a key, so that joins on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from labelscope.session import scratch_path


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, path: str | None = None,
                   name: str | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` and read it back.

    Rows move once, to the task of their bucket, so there is one file for each
    bucket. ``buckets`` (default: the session's shuffle partitions) must be the
    same for tables that are to be joined. ``name`` registers the table under
    a name of the catalog; without it the name is unique, and the files under
    ``path`` (default: a new scratch folder) stay."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = name or f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key)
       .option("path", path or scratch_path(spark, "bucketed")).saveAsTable(table))
    return spark.table(table)
