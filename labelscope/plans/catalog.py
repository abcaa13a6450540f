"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or relations Spark derives from them in
``plans/derived.py``) in full; limits appear only where the top-k or sample is
the feature itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.numeric import fixed
from labelscope.functions.text import decode_source_bytes
from labelscope.operators import corpus as C
from labelscope.operators import metrics as M
from labelscope.operators import report as R
from labelscope.operators import runs as RU
from labelscope.operators.detection_run import detection_run
from labelscope.operators.detector import run_pending
from labelscope.operators.requests import build_requests, prompt_chars, prompt_text
from labelscope.operators.responses import (
    compact_answers, detection_rows, explode_detections, extract_responses, match_answers, matched_rows,
    rejected_answers,
)
from labelscope.operators.verdicts import file_verdicts, item_labels, normalize_detections, unkeyed_rows, verdicts_of
from labelscope.plans import derived as D
from labelscope.session import scratch_path, stored
from labelscope.sources import csv_io
from labelscope.sources.bucketed import write_bucketed
from labelscope.sources.config import instruction_table, load_models
from labelscope.sources.corpus import read_items, read_texts, scan_files, write_items
from labelscope.sources.tables import load_table, spread

Query = Callable[[SparkSession, str], DataFrame]


def _verdicts(spark, sf_dir):
    det = D.detections(spark, sf_dir)
    return det, file_verdicts(det, D.DET_SYNONYMS, D.DET_TARGETS)


def q_normalize_label(spark, sf_dir):
    det = D.detections(spark, sf_dir)
    return (normalize_detections(det, D.DET_SYNONYMS, D.DET_TARGETS)
            .select("row_no", "model_name", "detected_pattern", "norm_label"))


def q_file_verdict(spark, sf_dir):
    det = D.detections(spark, sf_dir)
    v = file_verdicts(det, D.DET_SYNONYMS, D.DET_TARGETS, keep_gold_raw=True)
    return v.select("model_name", "filename", "gold_raw", "gold_label",
                    F.array_join("detected", ",").alias("detected"), "n_rows", "origin",
                    "in_scope", "correct")


def q_confusion_counts(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.confusion_counts(v, D.DET_TARGETS)


def q_prf_per_pattern(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.label_scores(v, D.DET_TARGETS)


def q_prf_micro(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.micro_scores(v, D.DET_TARGETS).drop("first_row")


def _labels(det, with_scores=False):
    """The one pass over the detections, written: everything else reads it."""
    return stored(item_labels(det, D.DET_SYNONYMS, D.DET_TARGETS, with_scores=with_scores), "item_labels")


def _hist(spark, sf_dir):
    # One use only: nothing to write.
    return M.ignored_histogram(item_labels(D.detections(spark, sf_dir), D.DET_SYNONYMS, D.DET_TARGETS), D.DET_TARGETS)


def q_ignored_hist(spark, sf_dir):
    return _hist(spark, sf_dir).select("model_name", "raw_label", "n")


def q_ignored_top5(spark, sf_dir):
    return M.top_ignored(_hist(spark, sf_dir))


def q_missed_sample(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.missed_sample(v)


def q_fp_sample(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.fp_sample(v)


def _round6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_score_stats(spark, sf_dir):
    det = D.detections(spark, sf_dir)
    return _round6(M.score_stats(det), {"confidence_mean", "adherence_mean"})


def q_duration_stats(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    out = M.duration_stats(v)
    return _round6(out, {"duration_mean_by_row", "duration_total_by_row",
                         "duration_mean_by_call", "duration_total_by_call"})


def q_source_accuracy(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.source_accuracy(v)


def q_metrics_by_scope(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.scores_by_scope(v, D.DET_TARGETS)


def q_leaderboard(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.leaderboard(M.micro_scores(v, D.DET_TARGETS))


def q_best_model(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.best_model(M.micro_scores(v, D.DET_TARGETS))


def q_baseline_compare(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.baseline_compare(M.micro_scores(v, D.DET_TARGETS))


# -- corpus ------------------------------------------------------------------

def _collection(spark, sf_dir, which):
    """A collection of source files, laid out as a folder for each file."""
    items = D.source_items(spark, sf_dir)[which]
    folders = (("gold_label",), ("project", "gold_label"))[which]
    return write_items(items, scratch_path(spark, f"collection{which + 1}"), label_cols=folders)


def q_corpus_scan(spark, sf_dir):
    """Listing of the second collection's files."""
    return scan_files(spark, _collection(spark, sf_dir, 1), layout="folder").select("filename", "gold_label", "length")


def q_corpus_read(spark, sf_dir):
    """The first collection's files with their decoded texts."""
    return read_items(spark, _collection(spark, sf_dir, 0), layout="folder").select(
        "filename", "gold_label", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def q_corpus_build(spark, sf_dir):
    """From both collections to one written corpus, read back. An earlier,
    larger build lies there before."""
    roots = [_collection(spark, sf_dir, i) for i in range(2)]
    path = f"{scratch_path(spark, 'index')}/index.csv"
    csv_io.write_csv(D.source_index(spark, sf_dir), path)
    index = csv_io.read_csv(spark, path, "raw_label string, Project string, Class string", na_tokens=None)
    listed = [scan_files(spark, r, (".java",), layout="folder") for r in roots]
    texts = [read_texts(spark, r, (".java",), layout="folder") for r in roots]
    out = scratch_path(spark, "corpus")
    C.build_corpus([C.index_collection(index, listed[0], n=D.CORPUS_SAMPLES + 5)], texts[:1], out)
    n = D.CORPUS_SAMPLES
    corpus = C.build_corpus([C.index_collection(index, listed[0], n=n), C.tree_collection(listed[1], n=n)], texts, out)
    return corpus.select("gold_label", "filename", "origin", F.md5("content").alias("content_md5"))


def q_path_label(spark, sf_dir):
    return (C.path_labels(D.corpus_paths(spark, sf_dir))
            .select("doc_id", "path", "filename", "stem", "ext", "gold_label"))


def q_text_decode(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    dec = decode_source_bytes(F.encode("text", "UTF-8"))
    return docs.select("doc_id", dec.alias("t")).select(
        "doc_id", F.length("t").alias("decoded_chars"),
        F.size(F.split("t", "\n")).alias("decoded_lines"), F.md5("t").alias("decoded_md5"))


def q_label_map_join(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    index = ev.select("event_id", F.expr(D.INDEX_LABEL).alias("raw_label"),
                      F.expr(D.INDEX_PROJECT).alias("Project"),
                      F.expr(D.INDEX_CLASS).alias("Class"))
    out = C.label_map_join(index, D.INDEX_LABEL_MAP, "raw_label")
    return out.select("event_id", "raw_label", "label", F.concat_ws(
        "-", F.lit("DPD"), "Project", F.concat("Class", F.lit(".java"))).alias("item_name"))


def _java_paths(spark, sf_dir):
    return C.path_labels(D.corpus_paths(spark, sf_dir), extensions=(".java",))


def q_keyword_label(spark, sf_dir):
    return C.keyword_labels(_java_paths(spark, sf_dir)).select("doc_id", "stem", "label")


def q_project_prefix(spark, sf_dir):
    return (C.project_names(_java_paths(spark, sf_dir), root="/data")
            .select("doc_id", "project", "item_name"))


def q_stratified_sample(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.stratified_sample(docs, "lang", "doc_id", n=10)


def q_sample_then_exists(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = load_table(spark, sf_dir, "labels")
    return C.sample_then_exists(docs, labels, "lang", "doc_id", n=25)


def q_dedup_keep_first(spark, sf_dir):
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    existing = part.where(F.col("p_size") <= 2).select("p_type", "p_name")
    return (C.dedup_keep_first(part.drop("p_size"), "p_type", "p_name", "p_partkey", n=10,
                               existing=existing)
            .select("p_type", "p_name", "p_partkey", "sample_rank"))


def q_corpus_summary(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("gold_label"), F.expr(D.DOC_ORIGIN).alias("origin"))
    return C.corpus_summary(docs)


# -- requests and responses ---------------------------------------------------------

def _request_digest(spark, sf_dir, models, instruction):
    docs = load_table(spark, sf_dir, "documents")
    items = docs.select(F.expr(D.DET_FILENAME).alias("filename"),
                        F.col("lang").alias("gold_label"), F.col("text").alias("content"))
    req = build_requests(items, models, instruction)
    return req.select("request_id", "filename", "model_name", "provider",
                      F.size("messages").alias("n_messages"),
                      prompt_chars("messages").alias("prompt_chars"),
                      F.md5(prompt_text("messages")).alias("prompt_md5"),
                      "temperature", "max_tokens")


def q_request_build(spark, sf_dir):
    return _request_digest(spark, sf_dir, D.REQUEST_MODELS, D.REQUEST_INSTRUCTION)


def q_request_files(spark, sf_dir):
    """The same requests, models and instruction read from files."""
    base = scratch_path(spark, "config")
    put = lambda text, name: spark.range(1).select(F.lit(text).alias("value")).write.text(f"{base}/{name}")
    put(json.dumps(D.REQUEST_MODELS), "models.json")
    put(f"\n  {D.REQUEST_INSTRUCTION}\n\n", "prompt.txt")
    return _request_digest(spark, sf_dir, load_models(spark, f"{base}/models.json"),
                           instruction_table(spark, f"{base}/prompt.txt"))


def q_index_csv(spark, sf_dir):
    """The index of a collection as CSV and back: labels such as NA and None
    are labels there."""
    path = csv_io.write_csv(D.source_index(spark, sf_dir), scratch_path(spark, "index"))
    return csv_io.read_csv(spark, path, "raw_label string, Project string, Class string", na_tokens=None)


def _detector_requests(spark, sf_dir):
    """Two requests for each document."""
    docs = load_table(spark, sf_dir, "documents").select(
        F.expr(D.DET_FILENAME).alias("filename"), F.col("lang").alias("gold_label"), F.col("text").alias("content"),
        F.col("doc_id").alias("item_no"))
    return build_requests(spread(docs, "item_no"), D.REQUEST_MODELS[:2], D.REQUEST_INSTRUCTION,
                          keep=("filename", "gold_label", "item_no"))


def _keyword_detector(started: str):
    """A detector that answers from the text alone; its calls start at ``started``."""
    keywords = dict(D.DETECTOR_KEYWORDS)

    def detector(pdf):
        import pandas as pd
        text = pdf["messages"].map(lambda m: m[-1]["content"].lower())
        answer = text.map(lambda t: next((f'{{"design_patterns": [{{"pattern": "{k}", "confidence": {len(t) % 101}}}]}}'
                                          for k, w in keywords.items() if w in t), "Error: no keyword"))
        start = pd.Timestamp(started)
        return pd.DataFrame({"request_id": pdf["request_id"], "raw_response": answer, "started_at": start,
                             "ended_at": start + pd.to_timedelta(text.str.len() % 60, unit="s")})

    return detector


_CARRIED = ("filename", "gold_label", "model_name", "item_no", "model_no")


def _resumed(spark, sf_dir):
    requests = _detector_requests(spark, sf_dir)
    path = scratch_path(spark, "answers")
    run_pending(requests.where("item_no % 2 = 0"), _keyword_detector("2025-01-01"), path, carry=_CARRIED)
    return run_pending(requests, _keyword_detector("2025-01-02"), path, waves=2, carry=_CARRIED)


def q_detector_resume(spark, sf_dir):
    """A detector run over half of the requests, then over all: the second
    asks only what the first did not."""
    return _resumed(spark, sf_dir).select("request_id", "raw_response", "started_at", "ended_at")


def q_detector_scores(spark, sf_dir):
    """The resumed run's answers, scored without a join back to the requests."""
    v = file_verdicts(detection_rows(None, _resumed(spark, sf_dir)), D.DET_SYNONYMS, D.DET_TARGETS)
    return M.micro_scores(v, D.DET_TARGETS).drop("first_row")


def q_detection_run(spark, sf_dir):
    """Items to scores in one call, with two models; a first call that asked
    only some of the requests had died. Scores of the combined scope and of
    each origin."""
    docs = load_table(spark, sf_dir, "documents").select(
        F.expr(D.DET_FILENAME).alias("filename"), F.col("lang").alias("gold_label"), F.col("doc_id").alias("item_no"),
        F.when(F.expr(f"NOT ({D.UNREADABLE})"), F.col("text")).alias("content"))
    base, run_id = scratch_path(spark, "run"), D.RUN_IDS[0]
    first = _detector_requests(spark, sf_dir).where("item_no % 4 = 0").where(f"NOT ({D.UNREADABLE.replace('doc_id', 'item_no')})")
    run_pending(first, _keyword_detector("2025-01-01"), f"{base}/answers/{run_id}", carry=_CARRIED)
    return detection_run(spread(docs, "item_no"), D.REQUEST_MODELS[:2], D.REQUEST_INSTRUCTION,
                         _keyword_detector("2025-01-02"), base, "documents", run_id, targets=D.DET_TARGETS,
                         synonyms=D.DET_SYNONYMS)["scopes"]


def q_evidence(spark, sf_dir):
    _, v = _verdicts(spark, sf_dir)
    return M.evidence(v)


def q_unkeyed_rows(spark, sf_dir):
    """Detection rows that belong to no item."""
    return unkeyed_rows(D.unkeyed_detections(spark, sf_dir)).select("row_no", "model_name", "detected_pattern")


def q_unkeyed_scores(spark, sf_dir):
    """Scores of the rows that do."""
    v = file_verdicts(D.unkeyed_detections(spark, sf_dir), D.DET_SYNONYMS, D.DET_TARGETS)
    return M.micro_scores(v, D.DET_TARGETS).drop("first_row")


def _extracted(spark, sf_dir):
    return extract_responses(D.responses(spark, sf_dir))


def q_response_extract(spark, sf_dir):
    ex = _extracted(spark, sf_dir)
    arr = F.try_variant_get("payload", "$['design_patterns']", "array<variant>")
    return ex.select("request_id", "model_name", "response_status", "parse_step", "parse_status",
                     F.when(arr.isNotNull(), F.size(arr)).alias("n_elements"))


def q_detection_explode(spark, sf_dir):
    return explode_detections(extract_responses(D.all_responses(spark, sf_dir)))


def q_csv_roundtrip(spark, sf_dir):
    ex = _extracted(spark, sf_dir)
    det = explode_detections(ex, keep=("request_id", "raw_response")).drop("is_fallback")
    path = scratch_path(spark, "csv_roundtrip")
    csv_io.write_csv(det, path)
    schema = ("request_id string, raw_response string, pos int, detected_pattern string, "
              "confidence string, adherence string, reasoning string")
    return csv_io.read_csv(spark, path, schema)


def q_csv_scores(spark, sf_dir):
    """Detection rows exported as CSV, re-read (NA tokens, file-order row
    numbers) and scored, as the detection run and the scoring job exchange
    them."""
    path = scratch_path(spark, "det_csv")
    csv_io.write_detections_csv(D.detections(spark, sf_dir), path, max_records=5_000)
    det = csv_io.read_detections_csv(spark, path)
    return M.micro_scores(file_verdicts(det, D.DET_SYNONYMS, D.DET_TARGETS),
                          D.DET_TARGETS).drop("first_row")


def q_csv_leaderboard(spark, sf_dir):
    """Leaderboard of two pairs of equal models, whose order is that of their
    first rows in many CSV files without row numbers."""
    path = scratch_path(spark, "det_csv_order")
    csv_io.write_detections_csv(D.paired_models(spark, sf_dir), path, export_row_no=False, max_records=2_000)
    det = csv_io.read_detections_csv(spark, path)
    return M.leaderboard(M.micro_scores(file_verdicts(det, D.DET_SYNONYMS, D.DET_TARGETS), D.DET_TARGETS),
                         keep=("first_row",))


def q_csv_rejects(spark, sf_dir):
    path = scratch_path(spark, "event_lines")
    D.event_lines(spark, sf_dir).write.text(path)
    return csv_io.csv_rejects(spark, path, D.EVENT_LINE_SCHEMA, header=False).select("record")


def q_detection_stream(spark, sf_dir):
    from labelscope.streaming.responses import stream_detections
    src = scratch_path(spark, "responses_in")
    D.all_responses(spark, sf_dir).write.mode("overwrite").parquet(src)
    out, ckpt = scratch_path(spark, "detections_out"), scratch_path(spark, "detections_ckpt")
    schema = spark.read.parquet(src).schema
    stream_detections(spark, src, schema, out, ckpt).awaitTermination()
    return spark.read.parquet(out)


def _matched(spark, sf_dir):
    """Requests and extracted answers, both written bucketed by request_id:
    their join has no exchange, and no response text moves."""
    answers = compact_answers(D.responses(spark, sf_dir).unionByName(D.late_responses(spark, sf_dir)))
    return match_answers(write_bucketed(D.response_requests(spark, sf_dir), "request_id"),
                         write_bucketed(answers, "request_id"))


def _response_detections(spark, sf_dir):
    return matched_rows(_matched(spark, sf_dir))


def q_response_orphans(spark, sf_dir):
    return rejected_answers(_matched(spark, sf_dir))


def q_response_matches(spark, sf_dir):
    """How many requests and answers of each model met, are missing or are
    left over."""
    return (_matched(spark, sf_dir).groupBy(F.coalesce("model_name", F.lit("")).alias("model_name"), "match")
            .agg(F.count(F.lit(1)).alias("n"), F.count("detections").alias("n_answers")))


def q_response_scores(spark, sf_dir):
    v = file_verdicts(_response_detections(spark, sf_dir))
    return M.micro_scores(v).drop("first_row")


def q_response_label_scores(spark, sf_dir):
    return M.label_scores(file_verdicts(_response_detections(spark, sf_dir)))


def q_response_durations(spark, sf_dir):
    out = M.duration_stats(file_verdicts(_response_detections(spark, sf_dir)))
    return _round6(out, {"duration_mean_by_row", "duration_total_by_row",
                         "duration_mean_by_call", "duration_total_by_call"})


def q_response_rejects(spark, sf_dir):
    from labelscope.operators.responses import rejected_elements
    return rejected_elements(extract_responses(D.all_responses(spark, sf_dir)))


def q_keyword_label_join(spark, sf_dir):
    from labelscope.functions.fixed_values import LABEL_KEYWORDS
    kw = spark.createDataFrame(
        [(label, k, i) for i, (label, ks) in enumerate(LABEL_KEYWORDS) for k in ks],
        "label string, keyword string, priority int")
    return (C.keyword_labels_join(_java_paths(spark, sf_dir), kw, key_col="doc_id")
            .select("doc_id", "stem", "label"))


def q_item_index(spark, sf_dir):
    from labelscope.operators.ordering import dense_index
    docs = load_table(spark, sf_dir, "documents").select(F.expr(D.DET_FILENAME).alias("filename"))
    return dense_index(docs, ["filename"], "item_no")


# -- runs --------------------------------------------------------------------

def _joined(df, name):
    """A list column as one text, for comparison."""
    return df.withColumn(name, F.array_join(name, ","))


def q_source_split(spark, sf_dir):
    return RU.split_by_origin(D.detections(spark, sf_dir)).select(
        "filename", "model_name", "row_no", "origin")


def q_run_metadata(spark, sf_dir):
    return _joined(RU.run_metadata(D.detections(spark, sf_dir), "documents"), "models_used")


def q_run_summary(spark, sf_dir):
    return _joined(RU.run_summary(D.detections(spark, sf_dir)), "models")


def q_run_write(spark, sf_dir):
    """Two runs and one that died before its marker, written as files and
    read back: rows by run and origin beside the run's metadata."""
    base = scratch_path(spark, "runs")
    det = D.detections(spark, sf_dir)
    first, second, died = D.RUN_IDS
    RU.commit_run(det.where("model_name = 'strict'"), base, first, "documents")
    RU.write_attempt(det.where("model_name = 'loose'"), base, second)     # a first attempt that died
    RU.commit_run(det, base, second, "documents")
    RU.write_attempt(det, base, died)
    rows = RU.read_runs(spark, base).groupBy("run_id", F.coalesce("origin", F.lit("")).alias("origin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("filename").alias("n_files"),
        F.sum("row_no").alias("row_no_sum"))
    return rows.join(_joined(RU.read_metadata(spark, base), "models_used"), "run_id")


def q_latest_committed(spark, sf_dir):
    """Scores of the latest committed run, though a later one has begun."""
    base = scratch_path(spark, "runs")
    det = D.detections(spark, sf_dir)
    first, second, died = D.RUN_IDS
    RU.commit_run(det, base, first, "documents")
    RU.commit_run(det.where("row_no % 32 < 16"), base, second)
    RU.write_attempt(det, base, died)
    return M.micro_scores(file_verdicts(RU.read_run(spark, base), D.DET_SYNONYMS, D.DET_TARGETS),
                          D.DET_TARGETS).drop("first_row")


def q_latest_run(spark, sf_dir):
    ev = load_table(spark, sf_dir, "events")
    runs = RU.runs_table(ev.select(F.expr(D.EVENT_RUN_ID).alias("run_id")))
    return RU.latest_run(runs)


# -- summaries ---------------------------------------------------------------

def _summary(spark, sf_dir):
    labels = _labels(D.detections(spark, sf_dir))
    return R.summary_table(verdicts_of(labels, D.DET_TARGETS), M.ignored_histogram(labels, D.DET_TARGETS), D.DET_TARGETS)


def q_summary_json(spark, sf_dir):
    return R.summary_json(_summary(spark, sf_dir))


def q_summary_rows(spark, sf_dir):
    """The summary written as JSON lines, read back and laid out as rows."""
    summary = _summary(spark, sf_dir)
    path = R.write_summary_json(summary, scratch_path(spark, "summary"))
    return R.summary_rows(spark.read.schema(summary.drop("first_row").schema).json(path))


def q_summary_ignored(spark, sf_dir):
    """Out-of-scope spellings of models that have very many."""
    labels = item_labels(D.many_spellings(spark, sf_dir), D.DET_SYNONYMS, D.DET_TARGETS)
    return R.summary_ignored(M.ignored_histogram(labels, D.DET_TARGETS))


def q_report_numbers(spark, sf_dir):
    """Numbers as the report prints them, of an integer and a decimal column."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    lines = load_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_extendedprice").alias("price"))
    texts = [fixed(F.col("n"), 0).alias("whole"), fixed(F.col("n") / 8, 2).alias("eighths"),
             fixed(F.col("n") / 1000.0, 1).alias("seconds"), fixed((F.col("n") % 101) / 101, 3).alias("score")]
    counted = docs.select("doc_id", *texts, F.lit(None).cast("string").alias("price"))
    none = [F.lit(None).cast("string").alias(c) for c in ("whole", "eighths", "seconds", "score")]
    return counted.unionByName(lines.select("doc_id", *none, fixed("price", 1).alias("price")))


def q_report_lines(spark, sf_dir):
    labels = _labels(D.detections(spark, sf_dir), with_scores=True)
    v = stored(verdicts_of(labels, D.DET_TARGETS), "verdicts")
    hist = stored(M.ignored_histogram(labels, D.DET_TARGETS), "histogram")
    lines = R.report_lines(R.summary_table(v, hist, D.DET_TARGETS), stats=M.score_stats_from_verdicts(v),
                           durations=M.duration_stats(v),
                           missed=M.missed_sample(v), fps=M.fp_sample(v),
                           top_ignored=M.top_ignored(hist))
    board = R.comparison_lines(M.micro_scores(v, D.DET_TARGETS)).select(
        F.lit("*").alias("model"), (F.col("section") + 10).alias("section"), "line_no", "line")
    return lines.unionByName(board)


QUERIES: dict[str, Query] = {
    "corpus_scan": q_corpus_scan,
    "corpus_read": q_corpus_read,
    "corpus_build": q_corpus_build,
    "path_label": q_path_label,
    "text_decode": q_text_decode,
    "label_map_join": q_label_map_join,
    "keyword_label": q_keyword_label,
    "project_prefix": q_project_prefix,
    "stratified_sample": q_stratified_sample,
    "sample_then_exists": q_sample_then_exists,
    "dedup_keep_first": q_dedup_keep_first,
    "corpus_summary": q_corpus_summary,
    "request_build": q_request_build,
    "request_files": q_request_files,
    "index_csv": q_index_csv,
    "detector_resume": q_detector_resume,
    "detector_scores": q_detector_scores,
    "detection_run": q_detection_run,
    "response_extract": q_response_extract,
    "detection_explode": q_detection_explode,
    "detection_stream": q_detection_stream,
    "response_rejects": q_response_rejects,
    "response_scores": q_response_scores,
    "response_label_scores": q_response_label_scores,
    "response_durations": q_response_durations,
    "response_orphans": q_response_orphans,
    "response_matches": q_response_matches,
    "keyword_label_join": q_keyword_label_join,
    "item_index": q_item_index,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_scores": q_csv_scores,
    "csv_leaderboard": q_csv_leaderboard,
    "csv_rejects": q_csv_rejects,
    "source_split": q_source_split,
    "run_metadata": q_run_metadata,
    "run_summary": q_run_summary,
    "latest_run": q_latest_run,
    "run_write": q_run_write,
    "latest_committed": q_latest_committed,
    "summary_json": q_summary_json,
    "summary_rows": q_summary_rows,
    "summary_ignored": q_summary_ignored,
    "report_numbers": q_report_numbers,
    "report_lines": q_report_lines,
    "normalize_label": q_normalize_label,
    "file_verdict": q_file_verdict,
    "confusion_counts": q_confusion_counts,
    "prf_per_pattern": q_prf_per_pattern,
    "prf_micro": q_prf_micro,
    "ignored_hist": q_ignored_hist,
    "ignored_top5": q_ignored_top5,
    "missed_sample": q_missed_sample,
    "evidence": q_evidence,
    "unkeyed_rows": q_unkeyed_rows,
    "unkeyed_scores": q_unkeyed_scores,
    "fp_sample": q_fp_sample,
    "score_stats": q_score_stats,
    "duration_stats": q_duration_stats,
    "source_accuracy": q_source_accuracy,
    "metrics_by_scope": q_metrics_by_scope,
    "leaderboard": q_leaderboard,
    "best_model": q_best_model,
    "baseline_compare": q_baseline_compare,
}

FLAGSHIP = "prf_micro"
