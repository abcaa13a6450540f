"""Nested per-model summaries (JSON sink) and fixed-width report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions import fixed_values as FV
from labelscope.functions.fixed_values import DEFAULT_TARGETS
from labelscope.functions.numeric import fixed
from labelscope.functions.scores import with_prf
from labelscope.functions.text import bind
from labelscope.operators import metrics as M


def summary_table(verdicts: DataFrame, hist: DataFrame, targets: Sequence[str] = DEFAULT_TARGETS) -> DataFrame:
    """One row per model with the nested summary: model, precision, recall,
    f1, total_tp/fp/fn, pattern_scores (target order), ignored_detections (the
    most frequent raw labels -> rows), breakdown_by_source (origin ->
    correct/total/accuracy), debug_info.

    Label, origin and micro figures come from one grouping-sets aggregation
    over the verdicts. ``hist`` is ``metrics.ignored_histogram``: of a model's
    spellings, however many, only the top ones meet in its row, with the totals
    ``ignored_distinct`` and ``ignored_rows``; ``summary_ignored`` has them all
    as rows of a table beside it.
    """
    rows = M.label_rows(verdicts, targets, ["origin", "correct"]).withColumn(
        "correct_one", F.when((F.col("file_one") == 1) & F.col("correct"), 1).otherwise(0))
    g = (rows.groupingSets([["model_name", "label"], ["model_name", "origin"],
                            ["model_name"]], "model_name", "label", "origin")
         .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
              F.sum("file_one").alias("files"), F.sum("correct_one").alias("correct"),
              F.min("first_row").alias("first_row"),
              F.grouping("label").alias("__gl"), F.grouping("origin").alias("__go")))
    g = with_prf(g)
    is_label = (F.col("__gl") == 0) & F.col("label").isNotNull()
    is_origin = (F.col("__go") == 0) & F.col("origin").isNotNull()
    is_micro = (F.col("__gl") == 1) & (F.col("__go") == 1)

    def micro(c):
        return F.max(F.when(is_micro, F.col(c)))

    score = ["tp", "fp", "fn", "precision", "recall", "f1"]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in score[:3]], *[F.lit(0.0).alias(c) for c in score[3:]])
    per_model = g.groupBy("model_name").agg(
        micro("precision").alias("precision"), micro("recall").alias("recall"),
        micro("f1").alias("f1"), micro("tp").alias("total_tp"), micro("fp").alias("total_fp"),
        micro("fn").alias("total_fn"), micro("files").alias("files_processed"),
        micro("first_row").alias("first_row"),
        F.map_from_entries(F.collect_list(F.when(is_label, F.struct("label", F.struct(*score))))).alias("__found"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_origin, F.struct(
            "origin", F.struct("correct", F.col("files").alias("total"),
                               F.when(F.col("files") > 0, F.col("correct") / F.col("files"))
                                .otherwise(0.0).alias("accuracy")))))))
         .alias("breakdown_by_source"))
    # One entry for every target, in their order.
    found = lambda t: F.coalesce(F.try_element_at("__found", t), zero)
    per_model = per_model.withColumn("pattern_scores", F.transform(
        F.array(*[F.lit(t) for t in targets]),
        lambda t: F.struct(t.alias("pattern"), *[found(t)[c].alias(c) for c in score])))
    totals = hist.groupBy("model_name").agg(F.count(F.lit(1)).alias("ignored_distinct"),
                                            F.sum("n").alias("ignored_rows"))
    top = (M.top_ignored(hist)
           .groupBy("model_name")
           .agg(F.map_from_entries(F.transform(
               F.array_sort(F.collect_list(F.struct("rank", "raw_label", "n"))),
               lambda s: F.struct(s["raw_label"], s["n"]))).alias("ignored_detections")))
    hist = totals.join(top, "model_name", "left")
    out = per_model.join(hist, "model_name", "left")
    empty_map = F.create_map().cast("map<string,bigint>")
    return out.select(
        F.col("model_name").alias("model"), "precision", "recall", "f1",
        "total_tp", "total_fp", "total_fn", "pattern_scores",
        F.coalesce("ignored_detections", empty_map).alias("ignored_detections"),
        F.coalesce("ignored_distinct", F.lit(0)).alias("ignored_distinct"),
        F.coalesce("ignored_rows", F.lit(0)).alias("ignored_rows"),
        "breakdown_by_source",
        F.struct("files_processed", F.col("total_tp").alias("correct_count"),
                 F.col("total_fn").alias("missed_count"), F.col("total_fp").alias("fp_count"))
         .alias("debug_info"),
        "first_row")


def summary_ignored(hist: DataFrame) -> DataFrame:
    """All out-of-scope spellings of all models as rows: model, raw_label, n,
    share (of the model's out-of-scope rows)."""
    total = hist.groupBy("model_name").agg(F.sum("n").alias("__all"))
    return hist.join(total, "model_name").select(
        F.col("model_name").alias("model"), "raw_label", "n", (F.col("n") / F.col("__all")).alias("share"))


def summary_rows(summary: DataFrame) -> DataFrame:
    """The nested summary as flat rows: model, section (overall, pattern,
    source), name, and the figures that the section has."""
    null = lambda kind: F.lit(None).cast(kind)
    counts, scores = ("tp", "fp", "fn"), ("precision", "recall", "f1")

    def row(section, name, n, of, correct, total, accuracy):
        return F.struct(F.lit(section).alias("section"), name.alias("name"),
                        *[(n(c) if n else null("long")).alias(c) for c in counts],
                        *[(of(c) if of else null("double")).alias(c) for c in scores],
                        correct.alias("correct"), total.alias("total"), accuracy.alias("accuracy"))

    overall = row("overall", null("string"), lambda c: F.col(f"total_{c}"), F.col, F.col("debug_info.correct_count"),
                  F.col("debug_info.files_processed"), null("double"))
    patterns = F.transform("pattern_scores", lambda x: row("pattern", x["pattern"], lambda c: x[c], lambda c: x[c],
                                                           null("long"), null("long"), null("double")))
    sources = F.transform(F.map_entries("breakdown_by_source"), lambda x: row(
        "source", x["key"], None, None, x["value"]["correct"], x["value"]["total"], x["value"]["accuracy"]))
    return summary.select("model", F.explode(F.concat(F.array(overall), patterns, sources)).alias("r")) \
        .select("model", "r.*")


def summary_json(summary: DataFrame) -> DataFrame:
    """(model, summary_json) with one JSON object per model."""
    cols = [c for c in summary.columns if c != "first_row"]
    return summary.select("model", F.to_json(F.struct(*cols)).alias("summary_json"))


def write_summary_json(summary: DataFrame, path: str, hist: DataFrame | None = None) -> str:
    """JSON lines, one nested summary per model (non-ASCII kept); ``hist``
    goes beside it, to ``<path>_ignored``, a line for each spelling."""
    summary.drop("first_row").write.mode("overwrite").json(path)
    if hist is not None:
        summary_ignored(hist).write.mode("overwrite").json(f"{path}_ignored")
    return path


def _lines(df: DataFrame, section: int, lines) -> DataFrame:
    """(model, section, line_no, line) from an array-of-lines column."""
    return df.select(F.col("model"), F.lit(section).alias("section"),
                     F.posexplode(lines).alias("line_no", "line"))


def _with_texts(values, digits, fn):
    """``fn`` of the numbers as texts; their rounding is written out once."""
    texts = F.transform(F.array(*[v.cast("double") for v in values]), lambda x: fixed(x, digits))
    return bind(texts, lambda t: fn([t[i] for i in range(len(values))]))


def _fmt_table_row(name, tp, fp, fn, p, r, f1):
    return _with_texts((p, r, f1), FV.SCORE_DIGITS, lambda t: F.format_string(FV.REPORT_TABLE_ROW_FORMAT, name, tp, fp, fn, *t))


def _score_row(fmt, x):
    return _with_texts([x[c] for c in ("precision", "recall", "f1")], FV.SCORE_DIGITS,
                       lambda t: F.format_string(fmt, x["model_name"], *t))


def _spread_line(fmt, name):
    return _with_texts([F.col(f"{name}_min"), F.col(f"{name}_max")], FV.EXTREME_DIGITS,
                       lambda t: F.format_string(fmt, fixed(f"{name}_mean", FV.MEAN_DIGITS), *t))


def report_lines(summary: DataFrame, stats: DataFrame | None = None,
                 durations: DataFrame | None = None, missed: DataFrame | None = None,
                 fps: DataFrame | None = None, top_ignored: DataFrame | None = None) -> DataFrame:
    """Fixed-width text report per model: (model, section, line_no, line).

    Sections: header, out-of-scope top list, label table with the overall
    row, missed and false-positive samples, qualitative statistics, and the
    breakdown by origin. Optional inputs add their sections. Numbers are
    rounded as Python prints them (``functions.numeric.fixed``).
    """
    head = F.format_string(FV.REPORT_TABLE_HEAD_FORMAT, *[F.lit(x) for x in FV.REPORT_TABLE_HEAD])
    rule70, rule40 = F.lit(FV.REPORT_RULE), F.lit(FV.REPORT_SECTION_RULE)
    parts = [_lines(summary, 0, F.array(
        rule70, F.concat(F.lit(FV.REPORT_TITLE), F.upper("model")), rule70,
        F.format_string(FV.REPORT_FILES, F.col("debug_info.files_processed"))))]
    if top_ignored is not None:
        ti = (top_ignored.groupBy(F.col("model_name").alias("model"))
              .agg(F.array_sort(F.collect_list(F.struct("rank", "raw_label", "n"))).alias("t")))
        parts.append(_lines(ti, 1, F.concat(
            F.array(F.lit(FV.REPORT_IGNORED_HEAD)),
            F.transform("t", lambda x: F.format_string(FV.REPORT_IGNORED_LINE, x["raw_label"],
                                                       x["n"])))))
    per_label = F.transform("pattern_scores", lambda s: _fmt_table_row(
        s["pattern"], s["tp"], s["fp"], s["fn"], s["precision"], s["recall"], s["f1"]))
    overall = _fmt_table_row(F.lit(FV.REPORT_OVERALL), F.col("total_tp"), F.col("total_fp"),
                             F.col("total_fn"), F.col("precision"), F.col("recall"), F.col("f1"))
    trule = F.lit(FV.REPORT_TABLE_RULE)
    parts.append(_lines(summary, 2, F.concat(F.array(head, trule), per_label,
                                             F.array(trule, overall))))
    if missed is not None:
        m = (missed.groupBy(F.col("model_name").alias("model"))
             .agg(F.array_sort(F.collect_list(F.struct("rank", "filename", "expected",
                                                       "detected"))).alias("t")))
        parts.append(_lines(m, 3, F.concat(
            F.array(F.lit(FV.REPORT_MISSED_HEAD)),
            F.transform("t", lambda x: F.format_string(
                FV.REPORT_MISSED_LINE, x["filename"], x["expected"],
                F.array_join(F.split(x["detected"], ","), "', '"))))))
    if fps is not None:
        fpl = (fps.groupBy(F.col("model_name").alias("model"))
               .agg(F.array_sort(F.collect_list(F.struct("rank", "filename", "expected",
                                                         "wrong_detection"))).alias("t")))
        parts.append(_lines(fpl, 4, F.concat(
            F.array(F.lit(FV.REPORT_FP_HEAD)),
            F.transform("t", lambda x: F.format_string(
                FV.REPORT_FP_LINE, x["filename"], x["expected"],
                x["wrong_detection"])))))
    if stats is not None or durations is not None:
        q = summary.select("model")
        lines = [F.lit(FV.REPORT_QUALITY_HEAD), rule40]
        if stats is not None:
            q = q.join(stats.withColumnRenamed("model_name", "model"), "model", "left")
            lines += [
                F.when(F.col("confidence_n") > 0, _spread_line(FV.REPORT_CONFIDENCE, "confidence")),
                F.when(F.col("adherence_n") > 0, _spread_line(FV.REPORT_ADHERENCE, "adherence"))]
        if durations is not None:
            q = q.join(durations.withColumnRenamed("model_name", "model"), "model", "left")
            lines.append(F.when(F.col("n_rows") > 0, F.format_string(
                FV.REPORT_RESPONSE_TIME, fixed("duration_mean_by_row", FV.CALL_DIGITS),
                fixed("duration_total_by_row", FV.TOTAL_DIGITS))))
        parts.append(_lines(q, 5, F.filter(F.array(*lines), lambda x: x.isNotNull())))
    src = F.transform(F.map_entries("breakdown_by_source"), lambda e: F.format_string(
        FV.REPORT_SOURCE_LINE, e["key"], e["value"]["correct"], e["value"]["total"],
        fixed(e["value"]["accuracy"] * 100, FV.PERCENT_DIGITS)))
    parts.append(_lines(summary, 6, F.concat(F.array(F.lit(FV.REPORT_SOURCE_HEAD), rule40), src)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison_lines(micro: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Model comparison (F1 descending, first seen wins ties), best model,
    and the published scores: (section, line_no, line). Input is one row
    per model."""
    head = F.format_string(FV.REPORT_COMPARISON_HEAD_FORMAT,
                           *[F.lit(x) for x in FV.REPORT_COMPARISON_COLUMNS])
    row = FV.REPORT_COMPARISON_ROW_FORMAT
    trule = F.lit(FV.REPORT_TABLE_RULE)
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("f1")).alias("k"), F.col("first_row"),
                                             "model_name", "precision", "recall", "f1"))),
        lambda x: _score_row(row, x))
    best = F.max_by(F.struct("model_name", "f1"), F.struct(F.col("f1"), -F.col("first_row")))
    board = micro.agg(F.concat(
        F.array(F.lit(FV.REPORT_COMPARISON_HEAD), head, trule), rows,
        F.array(F.format_string(FV.REPORT_BEST, best["model_name"], fixed(best["f1"], FV.SCORE_DIGITS)))).alias("l"))
    pub = published if published is not None else M.published_scores(micro.sparkSession)
    pub_lines = pub.agg(F.concat(
        F.array(F.lit(FV.REPORT_PUBLISHED_HEAD), head, trule),
        F.transform(F.array_sort(F.collect_list(F.struct("model_name", "precision", "recall",
                                                         "f1"))),
                    lambda x: _score_row(row, x))).alias("l"))
    return (board.select(F.lit(0).alias("section"), F.posexplode("l").alias("line_no", "line"))
            .unionByName(pub_lines.select(F.lit(1).alias("section"),
                                          F.posexplode("l").alias("line_no", "line"))))
