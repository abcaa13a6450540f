"""Run configuration as tables: the instruction text and the models.

Nothing here is collected: ``operators.requests.build_requests`` takes the
tables into its plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.text import py_strip
from labelscope.operators.requests import MODEL_FIELDS
from labelscope.sources.paths import exists


def _found(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def instruction_table(spark: SparkSession, path: str) -> DataFrame:
    """The instruction file as a table of one trimmed text. More files than
    one under ``path`` are an error when the table is used."""
    texts = spark.read.text(_found(spark, path), wholetext=True).select(py_strip("value").alias("instruction"))
    one = F.when(F.count(F.lit(1)) == 1, F.max("instruction")).otherwise(
        F.raise_error(F.lit(f"not one instruction file: {path}")).cast("string"))
    return texts.agg(one.alias("instruction"))


def load_instruction(spark: SparkSession, path: str) -> str:
    """The instruction as a Python text (one small file)."""
    return instruction_table(spark, path).first()["instruction"]


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """The models list, a JSON array of objects (name, provider, model_id,
    api_key_env, endpoint_url), as a table with ``model_no`` in list order."""
    entry = "struct<" + ",".join(f"{f}:string" for f in MODEL_FIELDS) + ">"
    text = spark.read.text(_found(spark, path), wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<{entry}>")).alias("model_no", "m")) \
        .select("model_no", "m.*")


def write_json(df: DataFrame, path: str) -> str:
    """JSON-lines sink (run metadata, summaries)."""
    df.write.mode("overwrite").json(path)
    return path
