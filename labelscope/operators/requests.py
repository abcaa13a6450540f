"""Items x models -> request table for any offline detector.

Models, providers and the instruction are configuration: Python values or
tables. The accepted models become one array (a literal, or a scalar subquery
over the tables) that is exploded on each item in place, so the item table is
never shuffled or joined, and no configuration is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import (
    FIXED_TEMPERATURE, FIXED_TEMPERATURE_MODEL, JOINED_PROMPT_SEPARATOR, PROVIDERS,
)

MODEL_FIELDS = ("name", "provider", "model_id", "api_key_env", "endpoint_url")
_PROVIDER_FIELDS = "provider string, message_style string, temperature double, max_tokens int"

ModelsArg = Sequence[Mapping] | DataFrame
ProvidersArg = Mapping[str, tuple] | DataFrame


def models_table(spark: SparkSession, models: ModelsArg) -> DataFrame:
    """(name, provider, model_id, model_no) of a list or table of models;
    ``model_no`` counts them in their order (a table's own ``model_no`` stays)."""
    if not isinstance(models, DataFrame):
        rows = [(i, *(None if m.get(f) is None else str(m[f]) for f in MODEL_FIELDS[:3])) for i, m in enumerate(models)]
        models = spark.createDataFrame(rows, "model_no int, name string, provider string, model_id string")
    missing = {"name", "provider"} - set(models.columns)
    if missing:
        raise ValueError(f"models table lacks {sorted(missing)}")
    if "model_no" not in models.columns:
        # As many rows as a configuration has.
        models = models.withColumn("__at", F.monotonically_increasing_id()) \
            .withColumn("model_no", F.row_number().over(Window.orderBy("__at")) - 1)
    text = lambda c: (F.col(c).cast("string") if c in models.columns else F.lit(None).cast("string")).alias(c)
    return models.select(text("name"), F.lower(F.coalesce(F.col("provider").cast("string"), F.lit(""))).alias("provider"),
                         text("model_id"), F.col("model_no").cast("int").alias("model_no"))


def providers_table(spark: SparkSession, providers: ProvidersArg = PROVIDERS) -> DataFrame:
    """(provider, message_style, temperature, max_tokens), lower-case names."""
    if not isinstance(providers, DataFrame):
        providers = spark.createDataFrame([(k, *v) for k, v in providers.items()], _PROVIDER_FIELDS)
    return providers.select(F.lower("provider").alias("provider"), "message_style",
                            F.col("temperature").cast("double").alias("temperature"),
                            F.col("max_tokens").cast("int").alias("max_tokens"))


def accepted_models(spark: SparkSession, models: ModelsArg, providers: ProvidersArg = PROVIDERS) -> DataFrame:
    """Models of a known provider, with the provider's request parameters.

    A missing key does not reject a model: its calls just fail later with an
    'Error:' response, as in the reference run."""
    fixed = (F.col("provider") == "openai") & F.lower("model_id").contains(FIXED_TEMPERATURE_MODEL)
    both = models_table(spark, models).join(providers_table(spark, providers), "provider")
    return both.select("model_no", F.col("name").alias("model_name"), "provider", "model_id", "message_style",
                       F.when(fixed, F.lit(FIXED_TEMPERATURE)).otherwise(F.col("temperature")).alias("temperature"),
                       "max_tokens")


def rejected_models(spark: SparkSession, models: ModelsArg, providers: ProvidersArg = PROVIDERS) -> DataFrame:
    """Reject table: models of an unknown provider."""
    known = providers_table(spark, providers).select("provider")
    return models_table(spark, models).join(known, "provider", "left_anti").select(
        "name", "provider", "model_id", "model_no", F.lit("unknown_provider").alias("reason"))


def _check_known(models: ModelsArg, providers: ProvidersArg) -> None:
    """A list without any model of a known provider is a mistake; tables give
    no requests then."""
    if not isinstance(models, DataFrame) and not isinstance(providers, DataFrame):
        known = {k.lower() for k in providers}
        if not any(str(m.get("provider") or "").lower() in known for m in models):
            raise ValueError("no model with a known provider")


def build_requests(items: DataFrame, models: ModelsArg, instruction: str | DataFrame,
                   content_col: str = "content",
                   keep: Sequence[str] = ("filename", "gold_label"),
                   key_col: str = "filename",
                   providers: ProvidersArg = PROVIDERS) -> DataFrame:
    """One request per (item, accepted model).

    Columns: request_id, <keep>, model_no, model_name, provider, model_id,
    messages ARRAY<STRUCT<role, content>>, temperature, max_tokens.
    Chat providers get (system, user) messages; a joined-prompt provider gets
    one user message with instruction + separator + content. ``instruction``
    may be a table of one text (``sources.config.instruction_table``).
    """
    spark = items.sparkSession
    _check_known(models, providers)
    config = accepted_models(spark, models, providers)
    every = config.agg(F.array_sort(F.collect_list(F.struct(*config.columns)))).scalar()
    instr = F.lit(instruction) if isinstance(instruction, str) else instruction.agg(F.max(instruction.columns[0])).scalar()
    x = (items.select(*keep, F.col(content_col).alias("__content"))
              .withColumns({"__models": every, "__instruction": instr})
              .select(*keep, "__content", "__instruction", F.explode("__models").alias("m"))
              .select(*keep, "__content", "__instruction", "m.*"))
    instr = F.col("__instruction")
    chat = F.array(F.struct(F.lit("system").alias("role"), instr.alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col("__content").alias("content")))
    joined = F.array(F.struct(F.lit("user").alias("role"),
                              F.concat(instr, F.lit(JOINED_PROMPT_SEPARATOR),
                                       F.col("__content")).alias("content")))
    messages = F.when(F.col("message_style") == "joined", joined).otherwise(chat)
    return x.select(
        F.concat_ws("/", "model_name", key_col).alias("request_id"), *keep,
        "model_no", "model_name", "provider", "model_id", messages.alias("messages"),
        "temperature", "max_tokens")


def prompt_text(messages: Column | str = "messages") -> Column:
    """'role:content' lines of the messages (for hashing and size checks)."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")


def prompt_chars(messages: Column | str = "messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.aggregate(F.transform(m, lambda x: F.length(x["content"])), F.lit(0),
                       lambda acc, n: acc + n)
