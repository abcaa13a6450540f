"""Incremental response ingestion with Structured Streaming.

A detector writes response files into a folder while it runs; this job turns
each new file into detection rows (extraction + explode are row-wise, so the
stream is stateless and runs in append mode) and appends them to a parquet
table. The checkpoint lives in the shared checkpoint folder, so a restarted
or failed job resumes from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from labelscope.functions.fixed_values import PAYLOAD_KEY
from labelscope.operators.responses import explode_detections, extract_responses


def stream_detections(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                      out_dir: str, checkpoint: str, keep: Sequence[str] = ("request_id",),
                      payload_key: str = PAYLOAD_KEY, available_now: bool = True,
                      max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery (``availableNow``
    processes what is there in bounded batches, then stops)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    det = explode_detections(extract_responses(src, payload_key=payload_key), keep, payload_key)
    w = (det.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
