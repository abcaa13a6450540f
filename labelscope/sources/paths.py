"""Whether a path exists, in any store that Spark reads, and where it is mounted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's file system (metadata only). Errors other than absence
    (no permission, unknown store, network) are raised, not taken for it."""
    try:
        context = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        context = None
    if context is None:
        try:
            spark.read.format("binaryFile").load(path).schema
            return True
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return False
            raise
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p))


def mounted(spark: SparkSession, path: str) -> str | None:
    """The plain path of one in the file system that driver and executors
    mount (``file:``); None in any other store."""
    try:
        context = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        return None
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None
