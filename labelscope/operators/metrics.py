"""Scores from per-item verdicts.

Verdicts hold one row per (model, item); everything here reduces them to
tables with one row per model, per (model, label) or per (model, origin),
with partial aggregation, so no step moves more than the verdicts once. A
verdict gives a row for each label it holds, not for each target; the zeros of
the (model x target) grid are filled in afterwards, on one row per model.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import (
    DEFAULT_TARGETS, EVIDENCE_SAMPLE, PUBLISHED_SCORES, TOP_IGNORED,
)
from labelscope.functions.numeric import strict_number
from labelscope.functions.scores import with_prf
from labelscope.operators.verdicts import gold_of_first


def _target_array(targets: Sequence[str]):
    return F.array(*[F.lit(t) for t in targets])


COUNTS = ("tp", "fp", "fn")


def label_rows(verdicts: DataFrame, targets: Sequence[str] | None, extra_keys: Sequence[str] = (),
               count_fp_out_of_scope: bool = False) -> DataFrame:
    """(model_name, <extra_keys>, label, tp, fp, fn, file_one, first_row): one
    row for each detected label of a verdict and for its gold label, whatever
    the number of targets. A verdict without any has one row with a NULL label;
    ``file_one`` is 1 on the first row of each verdict, so item counts come
    out of the same aggregation. ``targets`` limits the counted labels (None:
    the verdicts hold only targets)."""
    gold, lab = F.col("gold_label"), F.col("label")
    known = (lambda c: c.isin(*targets)) if targets is not None else (lambda c: c.isNotNull())
    scoped = F.when(known(gold), gold)
    none = F.array().cast("array<string>")
    labels = F.when(F.col("gold_label").isNotNull(), F.array_union("detected", F.array("gold_label"))) \
        .otherwise(F.col("detected") if count_fp_out_of_scope else none)
    v = verdicts.withColumn("gold_label", scoped).select(
        "model_name", *extra_keys, "gold_label", "first_row",
        F.array_contains("detected", F.col("gold_label")).alias("__hit"),
        F.posexplode_outer(labels).alias("__i", "label"))
    is_gold = F.coalesce(lab == gold, F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    return v.select(
        "model_name", *extra_keys, F.when(known(lab), lab).alias("label"),
        one(is_gold & F.col("__hit")).alias("tp"), one(~is_gold & known(lab)).alias("fp"),
        one(is_gold & ~F.col("__hit")).alias("fn"), one(F.coalesce(F.col("__i"), F.lit(0)) == 0).alias("file_one"),
        "first_row")


def zero_filled(counts: DataFrame, targets: Sequence[str] | DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """(keys, label, tp, fp, fn) for every key and target: ``counts`` has a row
    for each label that occurs, and at least one (of a NULL label) for each
    key. Each key's counts are one map of at most as many labels as targets;
    the targets, exploded, look theirs up."""
    entry = F.struct(*COUNTS)
    by_key = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.when(F.col("label").isNotNull(), F.struct("label", entry)))).alias("__found"))
    # A table's list is a scalar subquery: a value of the plan, no join.
    listed = (targets.agg(F.array_sort(F.collect_set("label"))).scalar() if isinstance(targets, DataFrame)
              else _target_array(targets))
    by_key = by_key.withColumn("__targets", listed)
    zero = F.lit(0).cast("long")
    return by_key.select(*keys, "__found", F.explode("__targets").alias("label")) \
        .withColumn("__c", F.try_element_at("__found", F.col("label"))) \
        .select(*keys, "label", *[F.coalesce(F.col(f"__c.{c}"), zero).alias(c) for c in COUNTS])


def _literal(targets) -> Sequence[str] | None:
    return None if isinstance(targets, DataFrame) else list(targets)


def _sums():
    return [F.sum(c).alias(c) for c in COUNTS]


def confusion_counts(verdicts: DataFrame, targets: Sequence[str] | DataFrame = DEFAULT_TARGETS,
                     count_fp_out_of_scope: bool = False) -> DataFrame:
    """(model_name, label, tp, fp, fn) for every model and every target.

    TP: the item's gold label is in its detected set. FN: it is not. FP: each
    other detected label, credited to the detected label. Items whose gold is
    out of scope are skipped (their false positives too, unless
    ``count_fp_out_of_scope``).
    """
    rows = label_rows(verdicts, _literal(targets), (), count_fp_out_of_scope)
    return zero_filled(rows.groupBy("model_name", "label").agg(*_sums()), targets)


def label_scores(verdicts: DataFrame, targets: Sequence[str] | DataFrame = DEFAULT_TARGETS,
                 count_fp_out_of_scope: bool = False) -> DataFrame:
    """Per-label precision, recall, F1 (zero-guarded)."""
    return with_prf(confusion_counts(verdicts, targets, count_fp_out_of_scope))


def micro_scores(verdicts: DataFrame, targets: Sequence[str] | DataFrame = DEFAULT_TARGETS,
                 count_fp_out_of_scope: bool = False) -> DataFrame:
    """Micro-averaged scores per model, in one aggregation over the verdicts.

    files_processed counts every item of the model, including the ones whose
    gold is out of scope; correct/missed/fp counts equal the totals;
    first_row is the model's first detection row (tie order).
    """
    out = (label_rows(verdicts, _literal(targets), (), count_fp_out_of_scope)
           .groupBy("model_name")
           .agg(F.sum("tp").alias("total_tp"), F.sum("fp").alias("total_fp"),
                F.sum("fn").alias("total_fn"), F.sum("file_one").alias("files_processed"),
                F.min("first_row").alias("first_row")))
    out = with_prf(out, "total_tp", "total_fp", "total_fn")
    return out.select(
        "model_name", "files_processed", "total_tp", "total_fp", "total_fn",
        "precision", "recall", "f1",
        F.col("total_tp").alias("correct_count"), F.col("total_fn").alias("missed_count"),
        F.col("total_fp").alias("fp_count"), "first_row")


def ignored_histogram(labels: DataFrame, targets: Sequence[str] | DataFrame = DEFAULT_TARGETS,
                      key_cols: Sequence[str] = ("filename",), scored: Sequence[str] | None = None) -> DataFrame:
    """Out-of-scope detections per model, counted per row, raw spelling, from
    ``verdicts.item_labels`` (built with the same targets).

    Only rows of items whose gold label is a target count: an item's gold is
    that of its first row over all its spellings, a window over rows that are
    already reduced to one for each spelling; no join and no second look at
    the detections."""
    keys = ["model_name", *key_cols]
    first = F.min("__first").over(Window.partitionBy(*keys))
    found = labels.select(*keys, "ignored_label", "n_rows", "label_first_row", first.alias("__item_first"))
    gold = gold_of_first(targets if isinstance(targets, DataFrame) else list(targets), F.col("__item_first"))
    in_scope = gold.isNotNull() if scored is None else gold.isin(*scored)
    return (found.where(in_scope & F.col("ignored_label").isNotNull())
            .groupBy("model_name", F.col("ignored_label").alias("raw_label"))
            .agg(F.sum("n_rows").alias("n"),
                 F.min(F.struct(F.col(key_cols[0]).alias("item"),
                                F.col("label_first_row").alias("row"))).alias("first_seen")))


def top_ignored(hist: DataFrame, k: int | None = TOP_IGNORED) -> DataFrame:
    """Top-k (None: all) out-of-scope labels per model, by count, ties in first-seen order."""
    w = Window.partitionBy("model_name").orderBy(
        F.col("n").desc(), F.col("first_seen"), F.col("raw_label"))
    ranked = hist.withColumn("rank", F.row_number().over(w))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)) \
        .select("model_name", "rank", "raw_label", "n")


def evidence(verdicts: DataFrame, key_col: str = "filename") -> DataFrame:
    """The items behind the counts, all of them: (model_name, kind, item,
    expected, label). ``correct`` and ``missed`` have one row for each in-scope
    item, with what was detected (``none``) as ``label``, comma-joined;
    ``false_positive`` has one for each wrong label. As many rows as tp + fn +
    fp; ``missed_sample`` and ``fp_sample`` are its first few."""
    found = F.when(F.size("detected") > 0, F.array_join("detected", ",")).otherwise(F.lit("none"))
    one = F.array(F.struct(F.when(F.col("correct"), F.lit("correct")).otherwise(F.lit("missed")).alias("kind"),
                           found.alias("label")))
    wrong = F.transform(F.array_except("detected", F.array("gold_label")),
                        lambda x: F.struct(F.lit("false_positive").alias("kind"), x.alias("label")))
    return verdicts.where("in_scope").select(
        "model_name", F.col(key_col).alias("item"), F.col("gold_label").alias("expected"),
        F.explode(F.concat(one, wrong)).alias("e")).select("model_name", "e.kind", "item", "expected", "e.label")


def missed_sample(verdicts: DataFrame, k: int = EVIDENCE_SAMPLE,
                  key_col: str = "filename") -> DataFrame:
    """First k missed items per model in item order, with what was detected."""
    w = Window.partitionBy("model_name").orderBy(key_col)
    return (verdicts.where(F.col("in_scope") & ~F.col("correct"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("model_name", "rank", key_col, F.col("gold_label").alias("expected"),
                    F.when(F.size("detected") > 0, F.array_join("detected", ","))
                     .otherwise(F.lit("none")).alias("detected")))


def false_positives(verdicts: DataFrame, key_col: str = "filename") -> DataFrame:
    """(model_name, item, expected, wrong_detection) for in-scope items."""
    return (verdicts.where("in_scope")
            .select("model_name", key_col, F.col("gold_label").alias("expected"),
                    F.explode(F.array_except("detected", F.array("gold_label")))
                     .alias("wrong_detection")))


def fp_sample(verdicts: DataFrame, k: int = EVIDENCE_SAMPLE,
              key_col: str = "filename") -> DataFrame:
    """First k false positives per model in item order (ties by label)."""
    w = Window.partitionBy("model_name").orderBy(key_col, "wrong_detection")
    return (false_positives(verdicts, key_col)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("model_name", "rank", key_col, "expected", "wrong_detection"))


def score_stats(det: DataFrame) -> DataFrame:
    """Mean/min/max/count of numeric confidence and adherence per model.

    Statistics are per row (fallback rows contribute their 0 scores)."""
    conf = strict_number("confidence")
    adh = strict_number("adherence")
    return det.groupBy("model_name").agg(
        F.avg(conf).alias("confidence_mean"), F.min(conf).alias("confidence_min"),
        F.max(conf).alias("confidence_max"), F.count(conf).alias("confidence_n"),
        F.avg(adh).alias("adherence_mean"), F.min(adh).alias("adherence_min"),
        F.max(adh).alias("adherence_max"), F.count(adh).alias("adherence_n"))


def score_stats_from_verdicts(verdicts: DataFrame) -> DataFrame:
    """``score_stats`` from verdicts built with ``with_scores=True`` (same
    per-row statistics, no second read of detection rows)."""
    aggs = []
    for prefix, name in (("conf", "confidence"), ("adh", "adherence")):
        aggs += [(F.sum(f"{prefix}_sum") / F.sum(f"{prefix}_n")).alias(f"{name}_mean"),
                 F.min(f"{prefix}_min").alias(f"{name}_min"),
                 F.max(f"{prefix}_max").alias(f"{name}_max"),
                 F.sum(f"{prefix}_n").alias(f"{name}_n")]
    out = verdicts.groupBy("model_name").agg(*aggs)
    return out.select("model_name", "confidence_mean", "confidence_min", "confidence_max",
                      "confidence_n", "adherence_mean", "adherence_min", "adherence_max",
                      "adherence_n")


def duration_stats(verdicts: DataFrame) -> DataFrame:
    """Response time per model: per row (a call with k detections counts k
    times, as reported by the reference) and per call, from the per-item
    sums carried by the verdicts (one aggregation)."""
    return verdicts.groupBy("model_name").agg(
        (F.sum("dur_sum") / F.sum("dur_n")).alias("duration_mean_by_row"),
        F.sum("dur_sum").alias("duration_total_by_row"),
        F.sum("dur_n").alias("n_rows"),
        F.avg("call_duration").alias("duration_mean_by_call"),
        F.sum("call_duration").alias("duration_total_by_call"),
        F.count("call_duration").alias("n_calls"))


def source_accuracy(verdicts: DataFrame) -> DataFrame:
    """Accuracy by origin: items whose gold was detected / all items of the
    origin (the denominator includes out-of-scope items), plus in-scope."""
    return (verdicts.where(F.col("origin").isNotNull())
            .groupBy("model_name", "origin")
            .agg(F.sum(F.col("correct").cast("long")).alias("correct"),
                 F.count(F.lit(1)).alias("total"),
                 F.sum(F.col("in_scope").cast("long")).alias("total_in_scope"))
            .withColumn("accuracy", F.when(F.col("total") > 0,
                                           F.col("correct") / F.col("total")).otherwise(0.0)))


def scores_by_scope(verdicts: DataFrame,
                    targets_by_scope: Mapping[str, Sequence[str]] | Sequence[str] = DEFAULT_TARGETS,
                    all_scope: str = "ALL") -> DataFrame:
    """Combined and per-origin scores in one pass.

    Each verdict is credited to the combined scope and to its origin (items
    without an origin only to the combined one). ``targets_by_scope`` maps a
    scope name to its target list (verdicts must have been built with the
    union of them); a plain list applies to every scope. Output has one row
    per (scope, model, label) plus one micro row per (scope, model) with
    ``label`` NULL and ``level`` = 'micro'.
    """
    scoped = isinstance(targets_by_scope, (DataFrame, Mapping))
    if isinstance(targets_by_scope, DataFrame):
        of_scope = scope_targets(targets_by_scope, all_scope)

        def tset(scope):
            return F.coalesce(F.try_element_at("__scopes", scope), F.try_element_at("__scopes", F.lit(all_scope)))
    else:
        of_scope = {s: list(ts) for s, ts in targets_by_scope.items()} if scoped else {}
        default = of_scope.get(all_scope) if scoped else list(targets_by_scope)
        union = sorted({t for ts in of_scope.values() for t in ts} | set(default or []))

        def tset(scope):
            out = None
            for name, ts in of_scope.items():
                out = F.when(scope == name, _target_array(ts)) if out is None else out.when(scope == name, _target_array(ts))
            rest = _target_array(default or union)
            return rest if out is None else out.otherwise(rest)

    scope = F.explode(F.filter(F.array(F.lit(all_scope), F.col("origin")),
                               lambda s: s.isNotNull())).alias("scope")
    v = verdicts.select("model_name", "gold_label", "detected", "first_row", scope)
    from_table = isinstance(targets_by_scope, DataFrame)
    if scoped:
        v = v.withColumn("__scopes", of_scope) if from_table else v
        ts = tset(F.col("scope"))
        v = v.select("model_name", "scope", "first_row",
                     F.when(F.array_contains(ts, F.col("gold_label")), F.col("gold_label")).alias("gold_label"),
                     F.array_intersect("detected", ts).alias("detected"))
    rows = label_rows(v, None if scoped else union, ["scope"])
    # Per-label and micro rows in one aggregation (grouping sets).
    keys = ["scope", "model_name"]
    both = (rows.groupingSets([[*keys, "label"], keys], *keys, "label")
            .agg(*_sums(), F.grouping("label").alias("__micro")))
    is_label = (F.col("__micro") == 0) & F.col("label").isNotNull()
    entry = F.struct(*COUNTS)
    one = both.groupBy(*keys).agg(
        F.max(F.when(F.col("__micro") == 1, entry)).alias("__all"),
        F.map_from_entries(F.collect_list(F.when(is_label, F.struct("label", entry)))).alias("__found"))
    one = one.withColumn("__scopes", of_scope) if from_table else one
    zero = F.lit(0).cast("long")
    each = F.transform(tset(F.col("scope")), lambda t: F.struct(
        t.alias("label"), F.coalesce(F.try_element_at("__found", t),
                                     F.struct(*[zero.alias(c) for c in COUNTS])).alias("n")))
    micro = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("__all").alias("n")))
    out = one.select(*keys, F.explode(F.concat(micro, each)).alias("x")).select(
        *keys, F.when(F.col("x.label").isNull(), F.lit("micro")).otherwise(F.lit("label")).alias("level"),
        "x.label", "x.n.*")
    return with_prf(out).select("scope", "model_name", "level", "label", "tp", "fp", "fn",
                                "precision", "recall", "f1")


def scope_targets(targets: DataFrame, all_scope: str = "ALL") -> Column:
    """A targets table ``(label, scope)`` as a map scope -> sorted labels, a
    scalar subquery; a NULL scope means every scope."""
    common = targets.where("scope is null").agg(F.collect_set("label").alias("c")).scalar()
    named = targets.where("scope is not null").select("label", "scope").unionByName(
        targets.select(F.lit(None).cast("string").alias("label"), F.lit(all_scope).alias("scope")))
    by_scope = named.groupBy("scope").agg(F.collect_set("label").alias("own")).withColumn("c", common)
    entry = F.struct("scope", F.array_sort(F.array_union("own", "c")).alias("labels"))
    return by_scope.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def targets_table(targets: DataFrame, all_scope: str = "ALL") -> dict[str, list[str]]:
    """A targets table ``(label, scope)`` as scope -> labels; a NULL scope
    means every scope. It becomes part of the plan, so it is as small as a
    configuration is; ``file_verdicts`` takes label tables of any size."""
    rows = targets.select("label", "scope").distinct().collect()     # the labels that are scored
    common = [r["label"] for r in rows if r["scope"] is None]
    scopes = {r["scope"] for r in rows if r["scope"] is not None} | {all_scope}
    return {s: sorted(set(common) | {r["label"] for r in rows if r["scope"] == s})
            for s in scopes}


def leaderboard(micro: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Models by F1 descending; ties keep first-seen order. ``keep`` names
    further columns of ``micro``.

    The input is one row per model (tiny); the global sort gathers only those
    rows."""
    w = Window.orderBy(F.col("f1").desc(), F.col("first_row"))
    return (micro.withColumn("rank", F.row_number().over(w))
            .select("rank", "model_name", "precision", "recall", "f1", *keep))


def best_model(micro: DataFrame) -> DataFrame:
    """Top-1 model by F1 (first seen wins a tie), as one aggregate."""
    best = micro.agg(F.max_by(F.struct("model_name", "precision", "recall", "f1"),
                              F.struct(F.col("f1"), -F.col("first_row"))).alias("b"))
    return best.select("b.model_name", "b.f1", "b.precision", "b.recall")


def published_scores(spark) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHED_SCORES),
                                 "model_name string, precision double, recall double, f1 double")


def baseline_compare(micro: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Measured micro scores stacked with published scores (kind column)."""
    published = published if published is not None else published_scores(micro.sparkSession)
    measured = micro.select("model_name", "precision", "recall", "f1",
                            F.lit("measured").alias("kind"))
    return measured.unionByName(published.withColumn("kind", F.lit("published")))
