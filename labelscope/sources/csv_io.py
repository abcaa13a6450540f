"""Detection and index tables as CSV (export and re-import).

Parquet is the main table format; CSV is the interchange format. Cells may
hold new lines, quotes and commas, so the writer quotes with '"' and doubles
embedded quotes, and the reader parses multi-line records, a file in one task:
``max_records`` bounds the files that are written. On import, text that pandas
reads as missing (its default NA tokens) becomes NULL, and records that do not
fit the schema go to a reject table.

Row order carries meaning (an item's gold label is its first row's). It is the
order of the file names, then of the records in each file, whatever the sizes
of the files and the tasks that read them; or the exported ``row_no``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.fixed_values import CSV_NA_TOKENS
from labelscope.session import scratch_path

#: Records of a file that ``write_csv`` writes at most.
MAX_RECORDS = 200_000
_CORRUPT, _FILE, _SEQ = "__corrupt", "__file", "__seq"


def write_csv(df: DataFrame, path: str, max_records: int = MAX_RECORDS) -> str:
    """Header CSV; white space is kept as is (Spark trims it by default)."""
    (df.write.mode("overwrite").option("maxRecordsPerFile", max_records)
       .option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))
    return path


def write_detections_csv(det: DataFrame, path: str, export_row_no: bool = True,
                         max_records: int = MAX_RECORDS) -> str:
    """Detections in the order of ``row_no``: file names rise with it."""
    ordered = det.repartitionByRange("row_no").sortWithinPartitions("row_no")
    return write_csv(ordered if export_row_no else ordered.drop("row_no"), path, max_records)


def na_to_null(df: DataFrame, tokens: Sequence[str] = CSV_NA_TOKENS) -> DataFrame:
    """NA tokens -> NULL in every text column."""
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(f.name).isin(*toks), F.lit(None).cast("string"))
         .otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields])


def _reader(spark: SparkSession, header: bool):
    return (spark.read.option("header", header).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def _parsed(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """The schema's columns and the text of records that don't fit it."""
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    return _reader(spark, header).option("columnNameOfCorruptRecord", _CORRUPT).schema(full).csv(path)


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             na_tokens: Sequence[str] | None = CSV_NA_TOKENS, header: bool = True) -> DataFrame:
    """Read a header CSV written by ``write_csv`` (or pandas) with an explicit
    schema; multi-line quoted cells are parsed whole. Records that don't fit
    the schema are left out (``csv_rejects`` has them); multi-line records are
    always parsed whole, so a query of few columns leaves out the same."""
    df = _reader(spark, header).option("mode", "DROPMALFORMED").schema(_schema(schema)).csv(path)
    return na_to_null(df, na_tokens) if na_tokens is not None else df


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Reject table of ``read_csv``: file (name), record (text). The rejects
    are stored, since Spark does not give a corrupt record's text alone."""
    df = _parsed(spark, path, _schema(schema), header).where(F.col(_CORRUPT).isNotNull())
    store = scratch_path(spark, "csv_rejects")
    df.select("*", F.col("_metadata.file_name").alias(_FILE)).write.parquet(store)
    return spark.read.parquet(store).select(F.col(_FILE).alias("file"), F.col(_CORRUPT).alias("record"))


def _in_file_order(df: DataFrame, out_col: str) -> DataFrame:
    """Number the rows of a stored parse from 0: each file's rows follow the
    rows of all files with smaller names. Only a row for each file is sorted."""
    files = df.groupBy(_FILE).agg(F.min(_SEQ).alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = files.select(F.col(_FILE).alias("__of"), "__low",
                          (F.sum("__n").over(Window.orderBy(_FILE)) - F.col("__n")).alias("__before"))
    return df.join(before, F.col(_FILE) == F.col("__of")).withColumn(
        out_col, F.col("__before") + F.col(_SEQ) - F.col("__low")).drop("__of", "__low", "__before")


def read_detections_csv(spark: SparkSession, path: str,
                        na_tokens: Sequence[str] | None = CSV_NA_TOKENS) -> DataFrame:
    """Detection CSV -> table, columns matched by header name (any order;
    missing ones are NULL), typed with safe casts. ``row_no`` is the exported
    one, or the order of file names and records.

    The parse is stored first: then all rows have their file and place in it,
    and numbering needs no second parse."""
    from labelscope.operators.verdicts import DETECTION_SCHEMA
    header = _reader(spark, True).csv(path).columns
    parsed = _parsed(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in header]), True)
    store = scratch_path(spark, "csv_rows")
    # A file is read by one task from its start, so ids rise by one along it.
    parsed.select("*", F.col("_metadata.file_path").alias(_FILE), F.monotonically_increasing_id().alias(_SEQ)) \
        .write.parquet(store)
    raw = spark.read.parquet(store)
    if "row_no" not in header:
        raw = _in_file_order(raw, "row_no")
    raw = raw.where(F.col(_CORRUPT).isNull())
    if na_tokens is not None:
        raw = na_to_null(raw, na_tokens)
    present = set(raw.columns)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in present
                         else F.lit(None).cast(f.dataType)).alias(f.name) for f in DETECTION_SCHEMA.fields])
