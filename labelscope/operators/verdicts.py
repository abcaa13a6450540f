"""Detection rows -> normalised rows -> one verdict per (model, item).

This is the only shuffle over detection rows in scoring: a hash aggregate on
(model_name, key columns). Every aggregate in it has a fixed-width buffer
(a bit for each target, a packed first-row gold, counts and sums) and is
partial, so a hot item with a very large number of rows is collapsed
map-side before the exchange, and its state is a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.fixed_values import DEFAULT_TARGETS, ORIGINS
from labelscope.functions.labels import (
    MAX_INLINE_SYNONYMS, clean_label, is_ignored_label, origin_of, synonym_lookup,
)

DETECTION_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("ground_truth_label", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("detected_pattern", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("adherence", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("row_no", T.LongType()),
])

SynonymsArg = Mapping[str, str] | DataFrame | None
TargetsArg = Sequence[str] | DataFrame


def _score_aggs():
    from labelscope.functions.numeric import strict_number
    out = []
    for prefix, col in (("conf", "confidence"), ("adh", "adherence")):
        x = strict_number(col)
        out += [(f"{prefix}_sum", F.sum(x)), (f"{prefix}_n", F.count(x)),
                (f"{prefix}_min", F.min(x)), (f"{prefix}_max", F.max(x))]
    return out


def _duration():
    d = F.col("duration_seconds").cast("double")
    return F.when(~F.isnan(d), d)


def normalize_column(df: DataFrame, raw_col: str, out_col: str,
                     synonyms: SynonymsArg = None,
                     targets: TargetsArg | None = DEFAULT_TARGETS) -> DataFrame:
    """Add ``out_col`` = canonical target label of ``raw_col`` (or NULL).

    ``synonyms`` is a dict or a DataFrame ``(raw, label)`` with lower-case
    ``raw``; ``targets`` a sequence or a DataFrame ``(label)``. Dicts of at
    most ``MAX_INLINE_SYNONYMS`` entries are inlined as a literal map, larger
    ones become a table; tables are left equi-joins whose strategy Spark picks
    from their size.
    """
    spark = df.sparkSession
    if isinstance(synonyms, Mapping) and len(synonyms) > MAX_INLINE_SYNONYMS:
        synonyms = spark.createDataFrame(sorted(synonyms.items()), "raw string, label string")
    # Two projections: the cleaned text is computed once (Catalyst does not
    # collapse a projection that would repeat a non-trivial expression).
    out = df.withColumn("__clean", clean_label(raw_col))
    if isinstance(synonyms, DataFrame):
        syn = synonyms.select(F.col("raw").alias("__syn_raw"), F.col("label").alias("__syn_label")) \
            .dropDuplicates(["__syn_raw"])
        out = out.join(syn, F.col("__clean") == F.col("__syn_raw"), "left") \
            .withColumn("__clean", F.coalesce("__syn_label", "__clean")).drop("__syn_raw", "__syn_label")
        mapped = F.col("__clean")
    else:
        mapped = synonym_lookup(F.col("__clean"), synonyms)
    if isinstance(targets, DataFrame):
        known = targets.select(F.col("label").alias("__target")).distinct()
        out = out.withColumn("__clean", mapped).join(known, F.col("__clean") == F.col("__target"), "left")
        return out.withColumn(out_col, F.col("__target").cast("string")).drop("__clean", "__target")
    if targets is not None:
        mapped = F.when(mapped.isin(*targets), mapped).otherwise(F.lit(None).cast("string"))
    return out.withColumn(out_col, mapped.cast("string")).drop("__clean")


def normalize_detections(det: DataFrame, synonyms: SynonymsArg = None,
                         targets: TargetsArg | None = DEFAULT_TARGETS) -> DataFrame:
    """Detection rows plus ``norm_label`` (canonical target label or NULL)."""
    return normalize_column(det, "detected_pattern", "norm_label", synonyms, targets)


def drop_error_rows(det: DataFrame) -> DataFrame:
    """Detection rows of failed calls (status error or missing, or response
    text 'Error: ...') removed."""
    from labelscope.functions.fixed_values import ERROR_PREFIX
    if "response_status" in det.columns:
        return det.where(~F.coalesce(F.col("response_status").isin("error", "missing"), F.lit(False)))
    if "raw_response" not in det.columns:
        return det
    return det.where(~F.coalesce(F.col("raw_response").startswith(ERROR_PREFIX), F.lit(False)))


WORD = 63                            # targets whose hits one long holds beside its sign


def _labels_of(word, first: int, targets: Sequence[str]):
    """Labels of the set bits of a word; most words have one bit or none."""
    one = F.bit_count(word - F.lit(1).cast("long"))          # number of the only bit that is set
    here = F.array(*[F.lit(t) for t in targets[first:first + WORD]])
    bits = F.filter(F.sequence(F.lit(0), F.lit(min(WORD, len(targets) - first) - 1)),
                    lambda i: F.getbit(word, i) == 1)
    return (F.when(word == 0, F.array().cast("array<string>"))
            .when(F.bit_count(word) == 1, F.array(F.get(here, one.cast("int"))))
            .otherwise(F.transform(bits, lambda i: F.get(here, i))))


def _measures(targets: TargetsArg, with_scores: bool) -> list:
    """(name, aggregate over detection rows, aggregate of partial results)."""
    d = _duration()
    out = [("n_rows", F.count(F.lit(1)), F.sum), ("call_duration", F.max(d), F.max), ("dur_sum", F.sum(d), F.sum),
           ("dur_n", F.count(d), F.sum)]
    if with_scores:
        merge = {"sum": F.sum, "n": F.sum, "min": F.min, "max": F.max}
        out += [(name, agg, merge[name.split("_")[1]]) for name, agg in _score_aggs()]
    if isinstance(targets, DataFrame):
        out += [("__first", F.min(F.struct("row_no", "__gold_norm")), F.min),
                ("__found", F.collect_set("norm_label"), lambda c: F.array_distinct(F.flatten(F.collect_list(c))))]
        return out
    bits, tarr = _gold_bits(targets), F.array(*[F.lit(t) for t in targets])
    gold_code = F.coalesce(F.array_position(tarr, F.col("__gold_norm")), F.lit(0))
    one, bit = F.lit(1).cast("long"), F.array_position(tarr, F.col("norm_label")).cast("int") - 1
    out.append(("__first", F.min(F.col("row_no").cast("decimal(20,0)") * F.lit(1 << bits).cast("decimal(10,0)")
                                 + gold_code.cast("decimal(10,0)")), F.min))
    for f in range(0, len(targets), WORD):
        word = F.when((F.col("__bit") >= f) & (F.col("__bit") < f + WORD),
                      F.call_function("shiftleft", one, F.col("__bit") - f)).otherwise(F.lit(0).cast("long"))
        out.append((f"__w{f}", F.bit_or(word), F.bit_or))
    return [("__bit", bit, None), *out]


def _gold_bits(targets: Sequence[str]) -> int:
    return max(1, len(targets).bit_length())


def _normed(det: DataFrame, synonyms: SynonymsArg, targets: TargetsArg, key_cols: Sequence[str],
            exclude_errors: bool) -> DataFrame:
    det = drop_error_rows(det) if exclude_errors else det
    return normalize_column(normalize_detections(det, synonyms, targets), "ground_truth_label", "__gold_norm",
                            synonyms, targets).dropna(subset=list(key_cols))


def _origin_source(columns: Sequence[str], key_cols: Sequence[str]) -> str:
    """The origin prefix is read from the file name even when items are keyed
    by something longer (e.g. the full path)."""
    return "filename" if "filename" in columns else key_cols[0]


def _aggregated(normed: DataFrame, keys: Sequence[str], targets: TargetsArg, with_scores: bool, extra: Sequence = ()):
    measures = _measures(targets, with_scores)
    for name, expr, merge in measures:
        if merge is None:                                     # a column that the aggregates share
            normed = normed.withColumn(name, expr)
    return normed.groupBy(*keys).agg(*extra, *[agg.alias(name) for name, agg, merge in measures if merge is not None])


def gold_of_first(targets: TargetsArg, first=None):
    """The gold label that the packed first row holds."""
    first = F.col("__first") if first is None else first
    if isinstance(targets, DataFrame):
        return first["__gold_norm"]
    code = (first % F.lit(1 << _gold_bits(targets))).cast("int")
    return F.when(code > 0, F.get(F.array(*[F.lit(t) for t in targets]), code - 1))


def _finished(agg: DataFrame, targets: TargetsArg, origin_src: str, origins: Sequence[str]) -> DataFrame:
    if isinstance(targets, DataFrame):
        detected, first_row, gone = F.array_sort("__found"), F.col("__first.row_no"), ["__found"]
    else:
        firsts = range(0, len(targets), WORD)
        found = [_labels_of(F.col(f"__w{f}"), f, targets) for f in firsts] or [F.array().cast("array<string>")]
        detected, gone = F.array_sort(F.concat(*found)), [f"__w{f}" for f in firsts]
        first_row = F.expr(f"__first div {1 << _gold_bits(targets)}")
    return (agg.withColumn("gold_label", gold_of_first(targets)).withColumn("detected", detected)
               .withColumn("first_row", first_row).withColumn("origin", origin_of(origin_src, origins))
               .withColumn("in_scope", F.col("gold_label").isNotNull())
               .withColumn("correct", F.coalesce(F.array_contains("detected", F.col("gold_label")), F.lit(False)))
               .drop("__first", "__origin_src", *gone))


def file_verdicts(det: DataFrame, synonyms: SynonymsArg = None,
                  targets: TargetsArg = DEFAULT_TARGETS,
                  key_cols: Sequence[str] = ("filename",),
                  origins: Sequence[str] = ORIGINS,
                  exclude_errors: bool = False,
                  keep_gold_raw: bool = False,
                  with_scores: bool = False) -> DataFrame:
    """One row per (model_name, item) with the gold label and detected set.

    Columns: model_name, <key_cols>, gold_label (normalised gold of the
    item's first row, NULL when out of scope), detected (sorted distinct
    normalised labels), n_rows, call_duration, dur_sum, dur_n, first_row,
    origin, in_scope, correct, and gold_raw with ``keep_gold_raw``.
    ``exclude_errors`` leaves failed calls out instead of counting them as
    misses.

    With a sequence of targets every aggregate has a fixed-width buffer, so
    Spark runs a plain ``HashAggregate`` with map-side partial aggregation:
    the detected set is a bit for each target in longs merged by
    ``bit_or``, and the first row's gold is packed into
    ``min(row_no * 2^bits + gold code)`` (a
    decimal, so no row number overflows; bits = bit length of the number of
    targets). Targets of any number can be a DataFrame ``(label)``: labels are
    then joined, and an item's are a set of texts.
    Rows whose item key is NULL belong to no item and are left out (see
    ``unkeyed_rows``).
    ``keep_gold_raw`` adds ``min_by`` over the raw text, which needs a
    sort-based aggregate. ``with_scores`` adds per-item sums, counts and
    extremes of the numeric confidence and adherence (``conf_*``, ``adh_*``),
    so score statistics can be computed from the verdicts alone.
    """
    keys = ["model_name", *key_cols]
    src = _origin_source(det.columns, key_cols)
    extra = [F.min(src).alias("__origin_src")] if src not in keys else []
    if keep_gold_raw:
        extra.append(F.min_by("ground_truth_label", "row_no").alias("gold_raw"))
    targets = targets if isinstance(targets, DataFrame) else list(targets)
    agg = _aggregated(_normed(det, synonyms, targets, key_cols, exclude_errors), keys, targets, with_scores, extra)
    return _finished(agg, targets, src if src in keys else "__origin_src", origins)


def item_labels(det: DataFrame, synonyms: SynonymsArg = None, targets: TargetsArg = DEFAULT_TARGETS,
                key_cols: Sequence[str] = ("filename",), exclude_errors: bool = False,
                with_scores: bool = False, scored: Sequence[str] | None = None) -> DataFrame:
    """One pass over the detections that both the verdicts and the
    out-of-scope histogram come from: a row for each (model_name, item) and
    out-of-scope spelling (``ignored_label``; NULL for all other rows) with
    partial results. It is as small as the distinct spellings of the items;
    write it once, then use ``verdicts_of`` and ``metrics.ignored_histogram``.

    ``scored`` limits the labels in scope for the histogram when ``targets``
    are more (several scopes)."""
    keys = ["model_name", *key_cols]
    src = _origin_source(det.columns, key_cols)
    targets = targets if isinstance(targets, DataFrame) else list(targets)
    normed = _normed(det, synonyms, targets, key_cols, exclude_errors)
    in_scope = F.col("norm_label") if scored is None else F.when(F.col("norm_label").isin(*scored), F.col("norm_label"))
    normed = normed.withColumn("ignored_label", F.when(is_ignored_label("detected_pattern", in_scope),
                                                       F.col("detected_pattern")))
    extra = [F.min("row_no").alias("label_first_row")]
    extra += [F.min(src).alias("__origin_src")] if src not in keys else []
    return _aggregated(normed, [*keys, "ignored_label"], targets, with_scores, extra)


def verdicts_of(labels: DataFrame, targets: TargetsArg = DEFAULT_TARGETS, key_cols: Sequence[str] = ("filename",),
                origins: Sequence[str] = ORIGINS) -> DataFrame:
    """``file_verdicts`` from ``item_labels`` of the same targets."""
    keys = ["model_name", *key_cols]
    with_scores = "conf_sum" in labels.columns
    targets = targets if isinstance(targets, DataFrame) else list(targets)
    src = "__origin_src" if "__origin_src" in labels.columns else _origin_source(labels.columns, key_cols)
    extra = [F.min("__origin_src").alias("__origin_src")] if src == "__origin_src" else []
    agg = labels.groupBy(*keys).agg(*extra, *[merge(name).alias(name) for name, _, merge in
                                              _measures(targets, with_scores) if merge is not None])
    return _finished(agg, targets, src, origins)


def unkeyed_rows(det: DataFrame, key_cols: Sequence[str] = ("filename",)) -> DataFrame:
    """Reject table of ``file_verdicts``: detection rows with a NULL item key."""
    missing = F.lit(False)
    for c in key_cols:
        missing = missing | F.col(c).isNull()
    return det.where(missing)
