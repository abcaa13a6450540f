"""Model responses -> extracted payloads -> detection rows.

All of it is column expressions over the response table (VARIANT parsing,
regular expressions, higher-order array functions); nothing leaves the JVM
and extraction shuffles nothing. A response that cannot be read never fails
the job: it gets a status and a fallback detection row, and malformed list
elements go to a reject table.

Responses meet their requests after extraction: a response is by then a short
array of detections, so its text is in no exchange. Every request keeps its
place: one without a response is a failed call (``missing``), one answered
twice has its latest answer. Responses that belong to no request, or were
answered again later, are the rejects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import (
    ERROR_PREFIX, FALLBACK_LABEL, FALLBACK_REASON, FALLBACK_SCORE, MISSING_LABEL,
    MISSING_REASON, MISSING_SCORE, PAYLOAD_KEY, PY_WHITESPACE_CLASS,
)
from labelscope.functions.jsonx import BRACE_RE, FENCE_RE, is_json_object_text, strict_json

# (output column, payload field, default when the field is missing)
ELEMENT_FIELDS = (
    ("detected_pattern", "pattern", MISSING_LABEL),
    ("confidence", "confidence", MISSING_SCORE),
    ("adherence", "adherence", MISSING_SCORE),
    ("reasoning", "reason", MISSING_REASON),
)


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def response_status(text: Column) -> Column:
    """'null' | 'error' (text starting 'Error:') | 'ok'."""
    return (F.when(text.isNull(), F.lit("null"))
             .when(text.startswith(ERROR_PREFIX), F.lit("error"))
             .otherwise(F.lit("ok")))


def extract_responses(resp: DataFrame, text_col: str = "raw_response",
                      payload_key: str = PAYLOAD_KEY,
                      repair_unwrapped: bool = False) -> DataFrame:
    """Add response_status, parse_step, parse_status and ``payload`` (VARIANT).

    parse_step: 'whole' | 'fence' | 'braces' | 'repaired' | NULL.
    parse_status: 'null' | 'no_json' | 'not_object' | 'no_key' | 'empty'
    (falsy value) | 'not_list' (truthy non-list value) | 'ok' (non-empty list).
    ``repair_unwrapped`` also reads a bare ``"<key>": [...]`` answer.

    Each step is its own projection and runs only when the previous ones
    failed, so every candidate is parsed at most once per response.
    """
    path = _path(payload_key)
    t = F.col(text_col)
    df = resp.withColumn("__whole", strict_json(t))
    fence_txt = F.regexp_extract(t, FENCE_RE, 1)
    df = df.withColumn("__fence", F.when(F.col("__whole").isNull() & (fence_txt != ""),
                                         strict_json(fence_txt)))
    brace_txt = F.regexp_extract(t, BRACE_RE, 1)
    df = df.withColumn("__brace", F.when(F.col("__whole").isNull() & F.col("__fence").isNull()
                                         & (brace_txt != ""), strict_json(brace_txt)))
    step = (F.when(F.col("__whole").isNotNull(), F.lit("whole"))
             .when(F.col("__fence").isNotNull(), F.lit("fence"))
             .when(F.col("__brace").isNotNull(), F.lit("braces")))
    is_obj = (F.when(F.col("__whole").isNotNull(), is_json_object_text(t))
               .otherwise(F.col("__fence").isNotNull() | F.col("__brace").isNotNull()))
    df = df.select("*", step.alias("parse_step"),
                   F.coalesce("__whole", "__fence", "__brace").alias("payload"),
                   is_obj.alias("__is_obj")).drop("__whole", "__fence", "__brace")
    if repair_unwrapped:
        ws = PY_WHITESPACE_CLASS
        key_re = '"' + payload_key.replace("\\", "\\\\") + '"'
        bare = F.regexp_extract(t, r"(?s)(" + _escape_re(key_re) + ws + r"*:" + ws + r"*\[.*\])", 1)
        has_key = F.col("__is_obj") & F.try_variant_get("payload", path, "variant").isNotNull()
        df = df.withColumn("__fixed", F.when(~has_key & (bare != ""),
                                             strict_json(F.concat(F.lit("{"), bare, F.lit("}")))))
        use_fix = F.col("__fixed").isNotNull()
        df = (df.withColumn("parse_step", F.when(use_fix, F.lit("repaired")).otherwise(F.col("parse_step")))
                .withColumn("payload", F.when(use_fix, F.col("__fixed")).otherwise(F.col("payload")))
                .withColumn("__is_obj", F.col("__is_obj") | use_fix).drop("__fixed"))
    df = df.withColumn("__kv", F.when(F.col("__is_obj"), F.try_variant_get("payload", path, "variant")))
    kv = F.col("__kv")
    arr_size = F.size(F.try_variant_get(kv, "$", "array<variant>"))
    falsy = F.to_json(kv).rlike(r'^(null|false|""|\{\}|-?0(\.0*)?([eE][-+]?[0-9]+)?)$')
    status = (F.when(t.isNull(), F.lit("null"))
               .when(F.col("parse_step").isNull(), F.lit("no_json"))
               .when(~F.col("__is_obj"), F.lit("not_object"))
               .when(kv.isNull(), F.lit("no_key"))
               .when(arr_size > 0, F.lit("ok"))
               .when((arr_size == 0) | falsy, F.lit("empty"))
               .otherwise(F.lit("not_list")))
    return (df.withColumn("response_status", response_status(t))
              .withColumn("parse_status", status).drop("__is_obj", "__kv"))


def _escape_re(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in s)


def _elements(payload_key: str) -> Column:
    """Array of (pos, element, is_object) for the payload list."""
    arr = F.try_variant_get("payload", _path(payload_key), "array<variant>")
    arr = F.when(F.col("parse_status") == "ok", arr)
    return F.transform(arr, lambda e, i: F.struct(
        i.alias("pos"), e.alias("element"),
        F.schema_of_variant(e).startswith("OBJECT").alias("is_object")))


def _field(e: Column, key: str, default: str) -> Column:
    p = _path(key)
    return F.when(F.try_variant_get(e, p, "variant").isNull(), F.lit(default)) \
            .otherwise(F.try_variant_get(e, p, "string"))


def _fallback() -> Column:
    return F.struct(
        F.lit(-1).alias("pos"), F.lit(FALLBACK_LABEL).alias("detected_pattern"),
        F.lit(FALLBACK_SCORE).alias("confidence"), F.lit(FALLBACK_SCORE).alias("adherence"),
        F.lit(FALLBACK_REASON).alias("reasoning"), F.lit(True).alias("is_fallback"))


def detection_array(payload_key: str = PAYLOAD_KEY) -> Column:
    """The valid elements of an extracted response as structs, or the one
    fallback struct."""
    valid = F.filter(_elements(payload_key), lambda s: s["is_object"])
    rows = F.transform(valid, lambda s: F.struct(
        s["pos"].alias("pos"),
        *[_field(s["element"], k, d).alias(n) for n, k, d in ELEMENT_FIELDS],
        F.lit(False).alias("is_fallback")))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, rows).otherwise(F.array(_fallback()))


def explode_detections(extracted: DataFrame, keep: Sequence[str] = ("request_id",),
                       payload_key: str = PAYLOAD_KEY) -> DataFrame:
    """One row per valid detected element, or one fallback row per response.

    Columns: <keep>, pos (element index; -1 for the fallback row),
    detected_pattern, confidence, adherence, reasoning (text; a missing field
    takes its default, a JSON null stays NULL), is_fallback.
    """
    return (extracted.select(*keep, F.explode(detection_array(payload_key)).alias("d"))
            .select(*keep, "d.*"))


def rejected_elements(extracted: DataFrame, keep: Sequence[str] = ("request_id",),
                      payload_key: str = PAYLOAD_KEY) -> DataFrame:
    """Reject table: list elements that are not objects, and truthy payload
    values that are not lists (pos -1).

    Built with one ``explode`` per response, not with a filter on the status
    columns: a filter on them would be pushed below the projections that
    compute them and re-evaluate the whole extraction chain inside it.
    """
    reject = "struct<pos:int,element:string,reason:string>"
    bad = F.transform(F.filter(_elements(payload_key), lambda s: ~s["is_object"]),
                      lambda s: F.struct(s["pos"].alias("pos"),
                                         F.to_json(s["element"]).alias("element"),
                                         F.lit("element_not_object").alias("reason")))
    not_list = F.when(F.col("parse_status") == "not_list", F.array(F.struct(
        F.lit(-1).alias("pos"),
        F.to_json(F.try_variant_get("payload", _path(payload_key), "variant")).alias("element"),
        F.lit("value_not_list").alias("reason"))))
    empty = F.array().cast(f"array<{reject}>")
    rows = F.concat(F.coalesce(bad, empty), F.coalesce(not_list, empty))
    return (extracted.select(*keep, F.explode(rows).alias("r"))
            .select(*keep, "r.pos", "r.element", "r.reason"))


def attach_durations(responses: DataFrame, start_col: str = "started_at",
                     end_col: str = "ended_at", out_col: str = "duration_seconds") -> DataFrame:
    """Elapsed seconds between request and response time stamps."""
    micros = F.timestamp_diff("MICROSECOND", F.col(start_col), F.col(end_col))
    return responses.withColumn(out_col, micros.cast("double") / F.lit(1_000_000.0))


REQUEST_COLUMNS = ("request_id", "filename", "gold_label", "model_name", "item_no", "model_no")


def compact_answers(responses: DataFrame, payload_key: str = PAYLOAD_KEY,
                    repair_unwrapped: bool = False) -> DataFrame:
    """Responses without their text: request_id, response_status,
    parse_status, duration_seconds, ended_at and ``detections`` (the array of
    ``detection_array``). Write it with ``sources.bucketed.write_bucketed``,
    like the requests, and their join needs no exchange."""
    resp = responses if "duration_seconds" in responses.columns else attach_durations(responses)
    if "ended_at" not in resp.columns:
        resp = resp.withColumn("ended_at", F.lit(None).cast("timestamp_ntz"))
    ex = extract_responses(resp, payload_key=payload_key, repair_unwrapped=repair_unwrapped)
    return ex.select("request_id", "response_status", "parse_status", "duration_seconds", "ended_at",
                     detection_array(payload_key).alias("detections"))


def _numbered(answers: DataFrame) -> DataFrame:
    """``answer_no`` 1 for a request's latest answer, 2 and on for earlier
    ones. Answers without a request id are numbered 1 each."""
    w = Window.partitionBy("request_id").orderBy(F.col("ended_at").desc_nulls_last(),
                                                 F.xxhash64("response_status", "parse_status", "detections"))
    known = answers.filter("request_id is not null").withColumn("answer_no", F.row_number().over(w))
    return known.unionByName(answers.filter("request_id is null").withColumn("answer_no", F.lit(1)))


def match_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Full outer join of requests and answers (``compact_answers``): all
    columns of both and ``match``: answered, missing (a request without an
    answer), orphan (an answer without a request) or repeated (answered again
    later)."""
    asked = requests.select(*REQUEST_COLUMNS).withColumn("__asked", F.lit(True))
    told = _numbered(answers)
    both = asked.join(told, "request_id", "full_outer")
    match = (F.when(F.col("__asked").isNull(), F.lit("orphan"))
             .when(F.col("answer_no").isNull(), F.lit("missing"))
             .when(F.col("answer_no") > 1, F.lit("repeated")).otherwise(F.lit("answered")))
    return both.withColumn("match", match).drop("__asked")


def rejected_answers(matched: DataFrame) -> DataFrame:
    """Reject table of ``match_answers``: request_id, response_status,
    parse_status, n_detections (fallback rows not counted), reason."""
    found = F.filter("detections", lambda d: ~d["is_fallback"])
    return matched.where(F.col("match").isin("orphan", "repeated")).select(
        "request_id", "response_status", "parse_status", F.size(found).alias("n_detections"),
        F.col("match").alias("reason"))


#: ``row_no`` holds the item in 35 bits, the model in 16 and the element in 12.
_MODEL_BITS, _POS_BITS = 16, 12


def row_number(item_no: Column, model_no: Column, pos: Column) -> Column:
    """Orders rows by item, model and element whatever their partitions.
    Elements from 4,094 on share the last number of their response: they have
    its gold label, and only ties between them lose their order."""
    last = (1 << _POS_BITS) - 1
    model = F.when(model_no < (1 << _MODEL_BITS), model_no).otherwise(
        F.raise_error(F.lit("model_no beyond 16 bits")).cast("int"))
    return (item_no.cast("long") * F.lit(1 << (_MODEL_BITS + _POS_BITS)) + model * F.lit(1 << _POS_BITS)
            + F.least(pos + 1, F.lit(last)))


def matched_rows(matched: DataFrame) -> DataFrame:
    """The detection table of ``match_answers``: every request's rows; a
    missing one is a failed call, with the fallback row, status ``missing``
    and no duration."""
    chosen = F.when(F.col("match") == "missing", F.array(_fallback())).otherwise(F.col("detections"))
    return _detection_table(matched.where(F.col("match").isin("answered", "missing")).select(
        *REQUEST_COLUMNS, F.coalesce("response_status", F.lit("missing")).alias("response_status"),
        "duration_seconds", F.explode(chosen).alias("d")))


def _detection_table(rows: DataFrame, *text: str) -> DataFrame:
    return rows.select(
        "filename", F.col("gold_label").alias("ground_truth_label"), "model_name",
        "d.detected_pattern", "d.confidence", "d.adherence", "d.reasoning", *text, "response_status",
        "duration_seconds", row_number(F.col("item_no"), F.col("model_no"), F.col("d.pos")).alias("row_no"))


def detection_rows(requests: DataFrame | None, responses: DataFrame,
                   payload_key: str = PAYLOAD_KEY,
                   repair_unwrapped: bool = False) -> DataFrame:
    """Responses with their requests as the detection table (filename,
    ground_truth_label, model_name, detected_pattern, confidence, adherence,
    reasoning, response_status, duration_seconds, row_no).

    Every request gives rows (see ``match_answers``, ``matched_rows``).
    ``requests=None`` reads the request's columns from the responses
    themselves (no join) and keeps ``raw_response``. ``requests`` needs
    ``item_no`` (see ``operators.ordering.dense_index``) and ``model_no``.
    """
    if requests is not None:
        return matched_rows(match_answers(requests, compact_answers(responses, payload_key, repair_unwrapped)))
    # responses already carry the request columns (run_detector carry=...)
    resp = responses if "duration_seconds" in responses.columns else attach_durations(responses)
    ex = extract_responses(resp, payload_key=payload_key, repair_unwrapped=repair_unwrapped)
    return _detection_table(ex.select(*REQUEST_COLUMNS, "raw_response", "response_status", "duration_seconds",
                                      F.explode(detection_array(payload_key)).alias("d")), "raw_response")
