"""Relations derived from the driver tables, in Spark.

The evaluation inputs (detection rows, model responses, corpus paths) do not
exist in the driver data, so they are derived from it deterministically:

* ``det``   detection rows from ``documents`` x two marker-word detectors;
            gold label = ``lang``; targets en/fr/de, 'es' is out of scope.
* ``resp``  free-text model responses from ``events`` (JSON, fenced JSON,
            prose, unwrapped lists, malformed text, errors, top-level lists).
* ``paths`` corpus file paths from ``documents``.

Each is also written as a SQL ``WITH`` block in ``plans/oracle.py``. Plain
SQL expression text is shared by both engines where both parse it alike;
regular expressions go through the DataFrame API only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import FALLBACK_REASON
from labelscope.sources.tables import load_table, spread

# Label space of ``det``: code, full name.
LANGS = (("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish"))
DET_TARGETS = ("en", "fr", "de")
DET_SYNONYMS = {"english": "en", "french": "fr", "german": "de", "spanish": "es"}
# Detectors: name -> marker words per language (matched as whole words).
DET_MODELS = (
    ("strict", {"en": "the|and|with", "fr": "le|et|une|que",
                "de": "der|und|die|den", "es": "el|los|que|las"}),
    ("loose", {"en": "the|of|to", "fr": "la|les|des",
               "de": "ein|ist|das", "es": "y|en|por"}),
)
FALLBACK_LANG_IDX = 7


def marker_regex(words: str) -> str:
    """Whole-word, case-insensitive match of any of ``words``."""
    return r"(?i)(^|[^\p{L}\p{N}])(" + words + r")([^\p{L}\p{N}]|$)"


def all_markers_regex() -> str:
    """One pattern for every marker word of every detector (whole words).

    A single ``regexp_extract_all`` pass over a text finds which marker words
    occur; per-detector, per-language hits are then set overlaps. Same result
    as one ``marker_regex`` search per (detector, language), one third of the
    CPU time.
    """
    words = sorted({w for _, m in DET_MODELS for ws in m.values() for w in ws.split("|")},
                   key=lambda w: (-len(w), w))
    return r"(?i)(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])"


# --- shared SQL expression text (valid in Spark SQL and DuckDB) -------------

DET_FILENAME = ("CASE WHEN doc_id % 10 = 9 THEN 'X-' WHEN doc_id % 2 = 0 THEN 'DPD-' "
                "ELSE 'PMART-' END || CAST(doc_id AS STRING) || '.txt'")
DET_SPELLING = ("CASE (doc_id + lang_idx) % 6 WHEN 0 THEN upper(code) "
                "WHEN 1 THEN ' ' || code || ' ' WHEN 2 THEN full_name WHEN 3 THEN code "
                "WHEN 4 THEN 'lang:' || code "
                "ELSE chr(9) || upper(substr(code, 1, 1)) || substr(code, 2) || chr(10) END")
DET_CONFIDENCE = ("CASE (doc_id + lang_idx) % 7 "
                  "WHEN 0 THEN CAST(n_chars % 100 AS STRING) || '%' "
                  "WHEN 1 THEN 'high' "
                  "WHEN 2 THEN CAST(n_chars % 100 AS STRING) || '.5' "
                  "WHEN 3 THEN '1e' || CAST(n_chars % 3 AS STRING) "
                  "ELSE CAST((n_chars + lang_idx * 13) % 101 AS STRING) END")
DET_ADHERENCE = "CAST((doc_id * 7 + lang_idx) % 101 AS STRING)"
DET_DURATION = "CASE WHEN doc_id % 37 = 5 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) / 1000.0 END"
# Documents whose detections have no item name, in ``unkeyed``.
UNKEYED = "doc_id % 53 = 7"
DET_ROW_NO = "doc_id * 16 + model_idx * 8 + lang_idx"

RESP_LABEL1 = ("CASE event_type WHEN 'view' THEN 'Observer' WHEN 'click' THEN 'Factory Method' "
               "WHEN 'purchase' THEN 'Singleton' WHEN 'signup' THEN 'Decorator' ELSE 'Strategy' END")
RESP_LABEL2 = ("CASE user_id % 5 WHEN 0 THEN 'Pub-Sub' WHEN 1 THEN 'singleton pattern' "
               "WHEN 2 THEN 'Builder' WHEN 3 THEN 'wrapper' ELSE 'None' END")
RESP_CONF = "CAST(CAST(floor(value) AS BIGINT) AS STRING)"
RESP_ADH = "CAST(user_id % 101 AS STRING)"
RESP_E1 = ("'{\"pattern\": ' || CASE WHEN event_id % 11 = 0 THEN 'null' ELSE '\"' || "
           + RESP_LABEL1 + " || '\"' END || ', \"confidence\": ' || " + RESP_CONF
           + " || ', \"adherence\": ' || " + RESP_ADH
           + " || ', \"reason\": \"event ' || CAST(event_id AS STRING) || '\"}'")
RESP_E2 = ("'{\"pattern\": \"' || " + RESP_LABEL2 + " || '\", \"confidence\": \"' || "
           + RESP_CONF + " || '%\"}'")
RESP_ITEMS = ("(" + RESP_E1 + ") || CASE WHEN event_id % 3 = 0 THEN ', ' || " + RESP_E2
              + " ELSE '' END || CASE WHEN event_id % 13 = 0 THEN ', \"stray\"' ELSE '' END")
RESP_DOC = "'{\"design_patterns\": [' || " + RESP_ITEMS + " || ']}'"
RESP_TEXT = (
    "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CASE event_id % 8 "
    "WHEN 0 THEN " + RESP_DOC + " "
    "WHEN 1 THEN 'Sure.' || chr(10) || '```json' || chr(10) || " + RESP_DOC
    + " || chr(10) || '```' || chr(10) || 'Done {ok}' "
    "WHEN 2 THEN 'Here it is: ' || " + RESP_DOC + " || ' bye' "
    "WHEN 3 THEN '\"design_patterns\": [' || " + RESP_E1 + " || ']' "
    "WHEN 4 THEN '{\"design_patterns\": [' || " + RESP_E1 + " || ', }' "
    "WHEN 5 THEN 'Error: timeout after ' || CAST(event_id % 120 AS STRING) || 's' "
    "WHEN 6 THEN CASE WHEN event_id % 5 = 1 THEN '{\"design_patterns\": []}, {\"x\": 1}] tail' "
    "ELSE '{\"design_patterns\": []}' END "
    "ELSE '[' || " + RESP_DOC + " || ']' END END")
RESP_REQUEST_ID = "'req-' || CAST(event_id AS STRING)"
RESP_MODEL = "CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END"
RESP_MODEL_NO = "user_id % 3"
RESP_FILENAME = ("CASE WHEN event_id % 2 = 0 THEN 'DPD-' ELSE 'PMART-' END || 'ev' || "
                 "CAST(event_id AS STRING) || '.java'")
# Gold label of the item behind each response (labels of the evaluated
# workflow; 'decorator' and 'strategy' are out of its default scope).
RESP_GOLD = ("CASE WHEN user_id % 7 = 0 THEN 'singleton' ELSE CASE event_type "
             "WHEN 'view' THEN 'observer' WHEN 'click' THEN 'factory' "
             "WHEN 'purchase' THEN 'singleton' WHEN 'signup' THEN 'decorator' "
             "ELSE 'strategy' END END")
RESP_COLUMNS = (
    ("request_id", RESP_REQUEST_ID),
    ("event_id", "event_id"),
    ("model_name", RESP_MODEL),
    ("filename", RESP_FILENAME),
    ("raw_response", RESP_TEXT),
    ("started_at", "ts"),
)

# Some requests have no response, some responses no request.
RESP_ABSENT = "event_id % 89 = 5"
REQUEST_ABSENT = "event_id % 83 = 7"
# Some requests are answered twice; the second answer, a minute later, holds.
RESP_AGAIN = "event_id % 71 = 3"
RESP_AGAIN_TEXT = "'{\"design_patterns\": [{\"pattern\": \"Observer\"}]}'"

PATH_PROJECT = ("CASE CAST(substr(source, 4) AS INT) % 10 WHEN 0 THEN 'Ant 1.7' "
                "WHEN 1 THEN 'ArgoUML' WHEN 2 THEN 'Azureus 3.0' WHEN 3 THEN 'JHotDraw' "
                "WHEN 4 THEN 'DrJava' WHEN 5 THEN 'Eclipse JDT' WHEN 6 THEN 'Xerces' "
                "WHEN 7 THEN 'Xalan-J 2' WHEN 8 THEN 'Antlr2' ELSE 'libs' END")
PATH_STEM = ("CASE doc_id % 8 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'FactoryImpl' "
             "WHEN 2 THEN 'Observer' WHEN 3 THEN 'EventListener' WHEN 4 THEN 'Decorator' "
             "WHEN 5 THEN 'WrapperObserver' WHEN 6 THEN 'ObserverFactory' ELSE 'Plain' END "
             "|| CASE WHEN doc_id % 5 = 0 THEN '.v' ELSE '' END || CAST(doc_id AS STRING)")
PATH_EXT = ("CASE doc_id % 9 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.cpp' "
            "WHEN 3 THEN '.cs' WHEN 4 THEN '.js' WHEN 5 THEN '.ts' WHEN 6 THEN '.JAVA' "
            "WHEN 7 THEN '.txt' ELSE '.java.bak' END")
PATH_EXPR = ("'/data/' || (" + PATH_PROJECT + ") || '/' || lang || '/' || (" + PATH_STEM
             + ") || (" + PATH_EXT + ")")


# corpus-side expressions
DOC_ORIGIN = "CASE WHEN doc_id % 2 = 0 THEN 'DPD' ELSE 'PMART' END"
INDEX_LABEL = "upper(substr(event_type, 1, 1)) || substr(event_type, 2)"
INDEX_PROJECT = "'proj' || CAST(user_id % 17 AS STRING)"
INDEX_CLASS = "'C' || CAST(event_id AS STRING)"
INDEX_LABEL_MAP = {"Click": "navigation", "View": "navigation", "Purchase": "commerce",
                   "Signup": "account"}
RUN_IDS = ("2025-12-09_08-56-29", "2025-12-11_20-22-44", "2025-12-12_00-00-00")
EVENT_RUN_ID = "date_format(ts, 'yyyy-MM-dd_HH') || '-00-00'"

# The detector of ``detector_resume`` looks for these texts in this order.
DETECTOR_KEYWORDS = (("English", " the "), ("French", " le "), ("German", " der "), ("Spanish", " el "))

# request-side configuration for ``request_build``
REQUEST_MODELS = (
    {"name": "gpt-5", "provider": "openai", "model_id": "gpt-5"},
    {"name": "gemini-3.0-pro", "provider": "google", "model_id": "gemini-3-pro-preview"},
    {"name": "llama-3.3-70b-groq", "provider": "groq", "model_id": "llama-3.3-70b-versatile"},
    {"name": "in-house", "provider": "acme", "model_id": "x-1"},
)
REQUEST_INSTRUCTION = (
    "Name the languages used in the given text. Answer with JSON: "
    '{"design_patterns": [{"pattern": "<language>", "confidence": <0-100>, '
    '"adherence": <0-100>, "reason": "<why>"}]}')


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``det``: detection rows of two marker-word detectors over documents.

    The text is read once and reduced to eight hit flags right after the
    scan (one ``regexp_extract_all`` pass per text); only the flags go on.
    ``spread`` moves the text only when the scan has fewer partitions than
    the cluster runs at once (single-row-group test files).
    """
    docs = spread(load_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), "doc_id")
    found = F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(all_markers_regex()), 1), F.lower))
    flags = []
    for mi, (_, markers) in enumerate(DET_MODELS):
        for li, (code, _) in enumerate(LANGS):
            words = F.array(*[F.lit(w) for w in markers[code].split("|")])
            flags.append(F.arrays_overlap("__found", words).alias(f"h{mi}{li}"))
    hits = docs.select("doc_id", "lang", "n_chars", found.alias("__found")).select(
        "doc_id", "lang", "n_chars", *flags)
    per_model = []
    for mi, (name, _) in enumerate(DET_MODELS):
        found = F.filter(F.array(*[
            F.struct(F.lit(mi).alias("model_idx"), F.lit(name).alias("model_name"),
                     F.lit(li).alias("lang_idx"), F.lit(code).alias("code"),
                     F.lit(full).alias("full_name"), F.col(f"h{mi}{li}").alias("hit"))
            for li, (code, full) in enumerate(LANGS)]), lambda s: s["hit"])
        fallback = F.array(F.struct(
            F.lit(mi).alias("model_idx"), F.lit(name).alias("model_name"),
            F.lit(FALLBACK_LANG_IDX).alias("lang_idx"), F.lit(None).cast("string").alias("code"),
            F.lit(None).cast("string").alias("full_name"), F.lit(False).alias("hit")))
        per_model.append(F.when(F.size(found) > 0, found).otherwise(fallback))
    rows = hits.select("doc_id", "lang", "n_chars",
                       F.explode(F.concat(*per_model)).alias("d")).select(
        "doc_id", "lang", "n_chars", "d.*")
    fb = F.col("lang_idx") == FALLBACK_LANG_IDX
    return rows.select(
        F.expr(DET_FILENAME).alias("filename"),
        F.col("lang").alias("ground_truth_label"),
        "model_name",
        F.when(fb, F.lit("None")).otherwise(F.expr(DET_SPELLING)).alias("detected_pattern"),
        F.when(fb, F.lit("0")).otherwise(F.expr(DET_CONFIDENCE)).alias("confidence"),
        F.when(fb, F.lit("0")).otherwise(F.expr(DET_ADHERENCE)).alias("adherence"),
        F.when(fb, F.lit(FALLBACK_REASON)).otherwise(F.lit("marker hit")).alias("reasoning"),
        F.expr(DET_DURATION).alias("duration_seconds"),
        F.expr(DET_ROW_NO).cast("long").alias("row_no"),
    )


def all_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resp``: one free-text response per event."""
    ev = load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return _responses(ev)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resp`` as far as it has arrived: some requests have no response."""
    ev = load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type",
                                                    "value").where(f"NOT ({RESP_ABSENT})")
    return _responses(ev)


def _responses(ev: DataFrame) -> DataFrame:
    out = spread(ev, "event_id").select(*[F.expr(e).alias(n) for n, e in RESP_COLUMNS])
    # the call took (event_id % 60) seconds
    return out.withColumn("ended_at", F.col("started_at") + F.make_interval(
        secs=(F.col("event_id") % 60).cast("decimal(18,6)")))


def late_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second answers to some requests, a minute after the first."""
    resp = responses(spark, sf_dir).where(RESP_AGAIN)
    minute = F.expr("INTERVAL 1 MINUTE")
    return resp.withColumns({"raw_response": F.expr(RESP_AGAIN_TEXT), "started_at": F.col("started_at") + minute,
                             "ended_at": F.col("ended_at") + minute})


def response_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of ``resp`` (some responses have none): request_id,
    filename, gold_label, model_name, item_no, model_no."""
    ev = load_table(spark, sf_dir, "events").where(f"NOT ({REQUEST_ABSENT})")
    return ev.select(F.expr(RESP_REQUEST_ID).alias("request_id"),
                     F.expr(RESP_FILENAME).alias("filename"), F.expr(RESP_GOLD).alias("gold_label"),
                     F.expr(RESP_MODEL).alias("model_name"), F.col("event_id").alias("item_no"),
                     F.expr(RESP_MODEL_NO).cast("int").alias("model_no"))


def corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paths``: one corpus path per document (doc_id, path)."""
    docs = load_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.expr(PATH_EXPR).alias("path"))


def paired_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``det`` with a twin of each model that has the same rows, each just
    before the original's; ``row_no`` orders them all."""
    twin = F.explode(F.array(F.lit(0), F.lit(1))).alias("twin")
    det = detections(spark, sf_dir).select("*", twin)
    return det.withColumns({
        "model_name": F.when(F.col("twin") == 0, F.concat(F.lit("z-"), "model_name")).otherwise(F.col("model_name")),
        "row_no": F.col("row_no") * 2 + F.col("twin")}).drop("twin")


# Event records as text lines; some lack a cell, have one too many or no number.
EVENT_LINE = ("CASE event_id % 50 WHEN 1 THEN CAST(event_id AS STRING) || ',' || event_type "
              "WHEN 2 THEN CAST(event_id AS STRING) || ',\"' || event_type || '\",1,2' "
              "WHEN 3 THEN 'no ' || CAST(event_id AS STRING) || ',' || event_type || ',1' "
              "ELSE CAST(event_id AS STRING) || ',\"' || event_type || '\",' || CAST(user_id AS STRING) END")
EVENT_LINE_SCHEMA = "event_id long, event_type string, user_id long"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "events").select(F.expr(EVENT_LINE).alias("line"))


# Two collections of source files: documents of even ids with an index, of odd
# ids as a tree of projects. Some indexed files are not there.
SOURCE_NAME = "'proj' || CAST(doc_id % 17 AS STRING) || '-C' || CAST(doc_id AS STRING) || '.java'"
CORPUS_SAMPLES = 20
# Items that a detection run could not read.
UNREADABLE = "doc_id % 19 = 4"
SOURCE_LABEL = ("CASE doc_id % 14 WHEN 0 THEN 'Factory' WHEN 2 THEN 'Singleton' WHEN 4 THEN 'Observer' "
                "WHEN 6 THEN 'Decorator' WHEN 8 THEN 'None' WHEN 10 THEN 'NA' ELSE 'Bridge' END")
INDEXED = "doc_id % 2 = 0"
LISTED = "doc_id % 2 = 0 AND doc_id % 5 <> 0"
IN_TREE = "doc_id % 2 = 1 AND doc_id % 3 = 0"
TREE_PROJECT = ("CASE doc_id % 5 WHEN 0 THEN 'ArgoUML' WHEN 1 THEN 'JHotDraw 5.1' WHEN 2 THEN 'Xerces' "
                "WHEN 3 THEN 'misc' ELSE 'Antlr2' END")
TREE_NAME = ("CASE doc_id % 7 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'FactoryImpl' WHEN 2 THEN 'Observer' "
             "WHEN 3 THEN 'EventListener' WHEN 4 THEN 'Wrapper' WHEN 5 THEN 'WrapperObserver' ELSE 'Plain' END "
             "|| CAST(doc_id % 100 AS STRING) || CASE WHEN doc_id % 11 = 0 THEN '.txt' ELSE '.java' END")


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the first collection: raw_label, Project, Class."""
    docs = load_table(spark, sf_dir, "documents").where(INDEXED)
    return docs.select(F.expr(SOURCE_LABEL).alias("raw_label"),
                       F.expr("'proj' || CAST(doc_id % 17 AS STRING)").alias("Project"),
                       F.expr("'C' || CAST(doc_id AS STRING)").alias("Class"))


def source_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files of both collections: folder(s), filename, content."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    docs = spread(docs, "doc_id")
    first = docs.where(LISTED).select(F.lit("src").alias("gold_label"), F.expr(SOURCE_NAME).alias("filename"), "content")
    second = docs.where(IN_TREE).select(F.expr(TREE_PROJECT).alias("project"),
                                        F.concat(F.lit("d"), "doc_id").alias("gold_label"),
                                        F.expr(TREE_NAME).alias("filename"), "content")
    return first, second


# Out-of-scope rows (language 3 of LANGS) in 150 further spellings.
SPELLED = "CASE WHEN row_no % 8 = 3 THEN detected_pattern || '-' || CAST({} % 150 AS STRING) ELSE detected_pattern END"


def many_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).withColumn("detected_pattern", F.expr(SPELLED.format("(row_no div 16)")))


def unkeyed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``det`` where some rows have lost their item's name."""
    lost = F.expr(UNKEYED.replace("doc_id", "(row_no div 16)"))
    return detections(spark, sf_dir).withColumn("filename", F.when(~lost, F.col("filename")))
