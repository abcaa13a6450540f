"""labelscope: label-detection evaluation on Spark.

Corpus preparation, request/response tables for any offline detector, and
per-item scoring (TP/FP/FN, precision/recall/F1 per label, micro averages,
per-origin breakdowns, statistics, leaderboards) expressed as DataFrame
transformations. Every public operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
