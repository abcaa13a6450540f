"""DuckDB oracle SQL for the registered queries.

Each query of ``plans/catalog.py`` has an independent SQL formulation here
over the same driver tables (pre-registered as views). Derived relations are
``WITH`` blocks built from the same expression text as ``plans/derived.py``
(``CAST(... AS STRING)`` is valid in both engines); regular expressions are
written out for RE2.
"""

from __future__ import annotations

from labelscope.functions.fixed_values import (
    FALLBACK_REASON, PUBLISHED_SCORES, PY_WHITESPACE_CLASS,
)
from labelscope.plans import derived as D

STRIP_RE = f"^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_clean(x: str) -> str:
    low = f"lower(regexp_replace(CAST({x} AS VARCHAR), {q(STRIP_RE)}, '', 'g'))"
    return f"(CASE WHEN {low} IN ('none', '') THEN NULL ELSE {low} END)"


def sql_norm(x: str, synonyms: dict, targets) -> str:
    c = sql_clean(x)
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(synonyms.items()))
    m = f"coalesce(CASE {c} {whens} END, {c})" if synonyms else c
    tl = ", ".join(q(t) for t in targets)
    return f"(CASE WHEN {m} IN ({tl}) THEN {m} END)"


def sql_origin(x: str) -> str:
    return (f"(CASE WHEN starts_with({x}, 'DPD-') THEN 'DPD' "
            f"WHEN starts_with({x}, 'PMART-') THEN 'PMART' END)")


def sql_prf(tp: str, fp: str, fn: str) -> str:
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0.0 END)"
    f = f"(CASE WHEN {p} + {r} > 0 THEN 2.0 * ({p} * {r}) / ({p} + {r}) ELSE 0.0 END)"
    return f"{p} AS precision, {r} AS recall, {f} AS f1"


def _det_cte() -> str:
    flags = []
    for mi, (_, markers) in enumerate(D.DET_MODELS):
        for li, (code, _) in enumerate(D.LANGS):
            flags.append(f"regexp_matches(text, {q(D.marker_regex(markers[code]))}) AS h{mi}{li}")
    unions = []
    for mi, (name, _) in enumerate(D.DET_MODELS):
        none_hit = "NOT (" + " OR ".join(f"h{mi}{li}" for li in range(len(D.LANGS))) + ")"
        for li, (code, full) in enumerate(D.LANGS):
            unions.append(
                f"SELECT doc_id, lang, n_chars, {mi} AS model_idx, {q(name)} AS model_name, "
                f"{li} AS lang_idx, {q(code)} AS code, {q(full)} AS full_name, "
                f"h{mi}{li} AS hit, {none_hit} AS none_hit FROM det_flags")
    hits = " UNION ALL ".join(unions)
    fb = D.FALLBACK_LANG_IDX
    return f"""
det_flags AS (SELECT doc_id, lang, n_chars, {', '.join(flags)} FROM documents),
det_hits AS ({hits}),
det AS (
  SELECT {D.DET_FILENAME} AS filename, lang AS ground_truth_label, model_name,
         {D.DET_SPELLING} AS detected_pattern, {D.DET_CONFIDENCE} AS confidence,
         {D.DET_ADHERENCE} AS adherence, 'marker hit' AS reasoning,
         nullif({D.DET_DURATION}, 'NaN') AS duration_seconds, CAST({D.DET_ROW_NO} AS BIGINT) AS row_no
  FROM det_hits WHERE hit
  UNION ALL
  SELECT {D.DET_FILENAME}, lang, model_name, 'None', '0', '0', {q(FALLBACK_REASON)},
         nullif({D.DET_DURATION}, 'NaN'), CAST(doc_id * 16 + model_idx * 8 + {fb} AS BIGINT)
  FROM det_hits WHERE lang_idx = 0 AND none_hit
)"""


def _scoring_ctes(det_block: str | None = None, synonyms: dict | None = None,
                  targets=None) -> str:
    synonyms = D.DET_SYNONYMS if synonyms is None else synonyms
    targets = D.DET_TARGETS if targets is None else targets
    norm = sql_norm("detected_pattern", synonyms, targets)
    gold = sql_norm("gold_raw", synonyms, targets)
    tl = ", ".join(f"({q(t)})" for t in targets)
    return (det_block or _det_cte()) + f""",
det_n AS (SELECT *, {norm} AS norm_label FROM det),
verdict0 AS (
  SELECT model_name, filename, arg_min(ground_truth_label, row_no) AS gold_raw,
         list_sort(list_distinct(list(norm_label))) AS detected,
         count(*) AS n_rows, max(duration_seconds) AS call_duration, min(row_no) AS first_row
  FROM det_n GROUP BY model_name, filename),
verdict AS (
  SELECT *, {gold} AS gold_label, {sql_origin('filename')} AS origin
  FROM verdict0),
verdict_x AS (
  SELECT *, gold_label IS NOT NULL AS in_scope,
         coalesce(list_contains(detected, gold_label), false) AS correct
  FROM verdict),
targets(label) AS (VALUES {tl}),
contrib AS (
  SELECT v.model_name, t.label,
    CASE WHEN v.gold_label IS NOT NULL AND t.label = v.gold_label AND list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS tp,
    CASE WHEN v.gold_label IS NOT NULL AND t.label <> v.gold_label AND list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS fp,
    CASE WHEN v.gold_label IS NOT NULL AND t.label = v.gold_label AND NOT list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS fn
  FROM verdict_x v CROSS JOIN targets t),
counts AS (
  SELECT model_name, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn
  FROM contrib GROUP BY model_name, label),
micro AS (
  SELECT c.model_name, f.files_processed, f.first_row,
         CAST(sum(tp) AS BIGINT) AS total_tp, CAST(sum(fp) AS BIGINT) AS total_fp,
         CAST(sum(fn) AS BIGINT) AS total_fn
  FROM counts c JOIN (SELECT model_name, count(*) AS files_processed, min(first_row) AS first_row
                      FROM verdict_x GROUP BY model_name) f USING (model_name)
  GROUP BY c.model_name, f.files_processed, f.first_row),
micro_s AS (SELECT *, {sql_prf('total_tp', 'total_fp', 'total_fn')} FROM micro)"""


def scopes_sql() -> str:
    """Scores of the combined scope and of each origin, after the scoring CTEs."""
    return f""",
contrib_s AS (
  SELECT v.origin, v.model_name, t.label,
    CASE WHEN v.gold_label IS NOT NULL AND t.label = v.gold_label AND list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS tp,
    CASE WHEN v.gold_label IS NOT NULL AND t.label <> v.gold_label AND list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS fp,
    CASE WHEN v.gold_label IS NOT NULL AND t.label = v.gold_label AND NOT list_contains(v.detected, t.label) THEN 1 ELSE 0 END AS fn
  FROM verdict_x v CROSS JOIN targets t),
scoped AS (
  SELECT 'ALL' AS scope, model_name, label, tp, fp, fn FROM contrib_s
  UNION ALL SELECT origin, model_name, label, tp, fp, fn FROM contrib_s WHERE origin IS NOT NULL),
per_label AS (
  SELECT scope, model_name, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
         CAST(sum(fn) AS BIGINT) AS fn FROM scoped GROUP BY scope, model_name, label),
both_levels AS (
  SELECT scope, model_name, 'label' AS level, label, tp, fp, fn FROM per_label
  UNION ALL
  SELECT scope, model_name, 'micro', NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT),
         CAST(sum(fn) AS BIGINT) FROM per_label GROUP BY scope, model_name)
SELECT scope, model_name, level, label, tp, fp, fn, {sql_prf('tp', 'fp', 'fn')} FROM both_levels"""


def scoring_sql(select: str) -> str:
    return "WITH " + _scoring_ctes() + "\n" + select


def det_sql(select: str) -> str:
    return "WITH " + _det_cte() + "\n" + select


def oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["prf_micro"] = scoring_sql("""
SELECT model_name, CAST(files_processed AS BIGINT) AS files_processed, total_tp, total_fp,
       total_fn, precision, recall, f1, total_tp AS correct_count, total_fn AS missed_count,
       total_fp AS fp_count
FROM micro_s""")
    out["confusion_counts"] = scoring_sql("SELECT model_name, label, tp, fp, fn FROM counts")
    out["prf_per_pattern"] = scoring_sql(
        f"SELECT model_name, label, tp, fp, fn, {sql_prf('tp', 'fp', 'fn')} FROM counts")
    out["normalize_label"] = scoring_sql(
        "SELECT row_no, model_name, detected_pattern, norm_label FROM det_n")
    out["file_verdict"] = scoring_sql("""
SELECT model_name, filename, gold_raw, gold_label, array_to_string(detected, ',') AS detected,
       CAST(n_rows AS BIGINT) AS n_rows, origin, in_scope, correct
FROM verdict_x""")
    hist = """
ign AS (
  SELECT d.model_name, d.filename, d.detected_pattern AS raw_label, d.row_no
  FROM det_n d JOIN verdict_x v ON d.model_name = v.model_name AND d.filename = v.filename
  WHERE v.in_scope AND d.detected_pattern IS NOT NULL
    AND lower(d.detected_pattern) NOT IN ('none', '') AND d.norm_label IS NULL),
hist AS (
  SELECT model_name, raw_label, CAST(count(*) AS BIGINT) AS n,
         min(filename) AS first_file
  FROM ign GROUP BY model_name, raw_label),
hist_first AS (
  SELECT h.*, (SELECT min(i.row_no) FROM ign i WHERE i.model_name = h.model_name
               AND i.raw_label = h.raw_label AND i.filename = h.first_file) AS first_row
  FROM hist h)"""
    out["ignored_hist"] = ("WITH " + _scoring_ctes() + "," + hist
                           + "\nSELECT model_name, raw_label, n FROM hist")
    out["ignored_top5"] = "WITH " + _scoring_ctes() + "," + hist + """
SELECT model_name, CAST(rank AS INTEGER) AS rank, raw_label, n FROM (
  SELECT *, row_number() OVER (PARTITION BY model_name
                               ORDER BY n DESC, first_file, first_row, raw_label) AS rank
  FROM hist_first) WHERE rank <= 5"""
    out["missed_sample"] = scoring_sql("""
SELECT model_name, CAST(rank AS INTEGER) AS rank, filename, expected, detected FROM (
  SELECT model_name, filename, gold_label AS expected,
         CASE WHEN len(detected) > 0 THEN array_to_string(detected, ',') ELSE 'none' END AS detected,
         row_number() OVER (PARTITION BY model_name ORDER BY filename) AS rank
  FROM verdict_x WHERE in_scope AND NOT correct) WHERE rank <= 5""")
    out["fp_sample"] = scoring_sql("""
SELECT model_name, CAST(rank AS INTEGER) AS rank, filename, expected, wrong_detection FROM (
  SELECT model_name, filename, expected, wrong_detection,
         row_number() OVER (PARTITION BY model_name ORDER BY filename, wrong_detection) AS rank
  FROM (SELECT model_name, filename, gold_label AS expected, unnest(detected) AS wrong_detection
        FROM verdict_x WHERE in_scope)
  WHERE wrong_detection <> expected) WHERE rank <= 5""")
    num = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    conf = f"(CASE WHEN regexp_matches(confidence, {q(num)}) THEN TRY_CAST(confidence AS DOUBLE) END)"
    adh = f"(CASE WHEN regexp_matches(adherence, {q(num)}) THEN TRY_CAST(adherence AS DOUBLE) END)"
    out["score_stats"] = det_sql(f"""
SELECT model_name,
       round(avg({conf}), 6) AS confidence_mean, min({conf}) AS confidence_min,
       max({conf}) AS confidence_max, CAST(count({conf}) AS BIGINT) AS confidence_n,
       round(avg({adh}), 6) AS adherence_mean, min({adh}) AS adherence_min,
       max({adh}) AS adherence_max, CAST(count({adh}) AS BIGINT) AS adherence_n
FROM det GROUP BY model_name""")
    out["duration_stats"] = scoring_sql("""
SELECT r.model_name, r.duration_mean_by_row, r.duration_total_by_row, r.n_rows,
       c.duration_mean_by_call, c.duration_total_by_call, c.n_calls FROM
 (SELECT model_name, round(avg(duration_seconds), 6) AS duration_mean_by_row,
         round(sum(duration_seconds), 6) AS duration_total_by_row,
         CAST(count(duration_seconds) AS BIGINT) AS n_rows FROM det GROUP BY model_name) r
 JOIN
 (SELECT model_name, round(avg(call_duration), 6) AS duration_mean_by_call,
         round(sum(call_duration), 6) AS duration_total_by_call,
         CAST(count(call_duration) AS BIGINT) AS n_calls FROM verdict_x GROUP BY model_name) c
 USING (model_name)""")
    out["source_accuracy"] = scoring_sql("""
SELECT model_name, origin, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct,
       CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CAST(in_scope AS INTEGER)) AS BIGINT) AS total_in_scope,
       sum(CAST(correct AS INTEGER)) / count(*) AS accuracy
FROM verdict_x WHERE origin IS NOT NULL GROUP BY model_name, origin""")
    out["metrics_by_scope"] = "WITH " + _scoring_ctes() + scopes_sql()
    out["leaderboard"] = scoring_sql("""
SELECT CAST(row_number() OVER (ORDER BY f1 DESC, first_row) AS INTEGER) AS rank,
       model_name, precision, recall, f1 FROM micro_s""")
    nul = lambda *c: ", ".join(f"NULL AS {x}" for x in c)
    out["summary_rows"] = scoring_sql(f"""
SELECT model_name AS model, 'overall' AS section, CAST(NULL AS VARCHAR) AS name, total_tp AS tp, total_fp AS fp,
       total_fn AS fn, precision, recall, f1, total_tp AS correct, files_processed::BIGINT AS total,
       CAST(NULL AS DOUBLE) AS accuracy FROM micro_s
UNION ALL SELECT model_name, 'pattern', label, tp, fp, fn, {sql_prf('tp', 'fp', 'fn')}, {nul('a', 'b', 'c')} FROM counts
UNION ALL SELECT model_name, 'source', origin, {nul('a', 'b', 'c', 'd', 'e', 'f')}, count(*) FILTER (correct), count(*),
       count(*) FILTER (correct) / count(*) FROM verdict_x WHERE origin IS NOT NULL GROUP BY model_name, origin""")
    spelled = "det AS (SELECT * REPLACE (" + D.SPELLED.format("(row_no // 16)") + " AS detected_pattern) FROM det_all)"
    out["summary_ignored"] = "WITH " + _scoring_ctes(_det_cte().replace(
        "\ndet AS (", "\ndet_all AS (") + ", " + spelled) + "," + hist + """
SELECT model_name AS model, raw_label, n, n / sum(n) OVER (PARTITION BY model_name) AS share FROM hist"""
    out["report_numbers"] = """
SELECT doc_id, printf('%.0f', n_chars::DOUBLE) AS whole, printf('%.2f', n_chars / 8::DOUBLE) AS eighths,
       printf('%.1f', n_chars / 1000::DOUBLE) AS seconds, printf('%.3f', (n_chars % 101) / 101::DOUBLE) AS score, NULL AS price
FROM documents
UNION ALL SELECT l_orderkey * 10 + l_linenumber, NULL, NULL, NULL, NULL, printf('%.1f', l_extendedprice::DOUBLE) FROM lineitem"""
    out["csv_leaderboard"] = scoring_sql("""
, places AS (SELECT model_name, min(place) AS first_row FROM (
    SELECT model_name, row_number() OVER (ORDER BY row_no) AS place FROM (
      SELECT model_name, row_no * 2 + 1 AS row_no FROM det
      UNION ALL SELECT 'z-' || model_name, row_no * 2 FROM det)) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY f1 DESC, p.first_row) AS INTEGER) AS rank, p.model_name,
       precision, recall, f1, p.first_row - 1 AS first_row
FROM micro_s m JOIN places p ON p.model_name IN (m.model_name, 'z-' || m.model_name)""")
    out["evidence"] = scoring_sql("""
SELECT model_name, CASE WHEN correct THEN 'correct' ELSE 'missed' END AS kind, filename AS item, gold_label AS expected,
       CASE WHEN len(detected) > 0 THEN array_to_string(detected, ',') ELSE 'none' END AS label
FROM verdict_x WHERE in_scope
UNION ALL SELECT model_name, 'false_positive', filename, gold_label, label
FROM (SELECT *, unnest(detected) AS label FROM verdict_x WHERE in_scope) WHERE label <> gold_label""")
    lost = D.UNKEYED.replace("doc_id", "(row_no // 16)")
    out["unkeyed_rows"] = det_sql(f"SELECT row_no, model_name, detected_pattern FROM det WHERE {lost}")
    out["unkeyed_scores"] = "WITH " + _scoring_ctes(_det_cte().replace(
        "\ndet AS (", "\ndet_all AS (") + f", det AS (FROM det_all WHERE NOT ({lost}))") + """
SELECT model_name, CAST(files_processed AS BIGINT) AS files_processed, total_tp, total_fp,
       total_fn, precision, recall, f1, total_tp AS correct_count, total_fn AS missed_count,
       total_fp AS fp_count
FROM micro_s"""
    out["report_lines"] = report_sql(hist)
    out["best_model"] = scoring_sql("""
SELECT model_name, f1, precision, recall FROM micro_s ORDER BY f1 DESC, first_row LIMIT 1""")
    pub = ", ".join(f"({q(m)}, {p!r}, {r!r}, {f!r})" for m, p, r, f in PUBLISHED_SCORES)
    out["baseline_compare"] = scoring_sql(f"""
SELECT model_name, precision, recall, f1, 'measured' AS kind FROM micro_s
UNION ALL
SELECT model_name, CAST(p AS DOUBLE), CAST(r AS DOUBLE), CAST(f AS DOUBLE), 'published'
FROM (VALUES {pub}) AS t(model_name, p, r, f)""")
    return out


# -- corpus, requests, responses, runs -----------------------------------------

from labelscope.functions.fixed_values import (  # noqa: E402
    BRACE_PATTERN, CSV_NA_TOKENS, DEFAULT_PROJECT, FENCE_PATTERN, JOINED_PROMPT_SEPARATOR, LABEL_KEYWORDS, PROJECT_PREFIXES,
    RAW_LABEL_MAP, SOURCE_EXTENSIONS,
)

# The extraction patterns as both engines read them: "\\s" is Python white space, "." also matches new lines.
FENCE_RE, BRACE_RE = (f"(?s){p}".replace(r"\s", PY_WHITESPACE_CLASS) for p in (FENCE_PATTERN, BRACE_PATTERN))

PATHS_CTE = f"paths AS (SELECT doc_id, {D.PATH_EXPR} AS path FROM documents)"
FN = "regexp_extract(path, '([^/]*)$', 1)"


def _path_cols(exts) -> str:
    kept = " OR ".join(f"ends_with(filename, {q(e)})" for e in exts)
    return f"""
p1 AS (SELECT doc_id, path, {FN} AS filename FROM paths),
p2 AS (SELECT doc_id, path, filename,
         CASE WHEN regexp_matches(filename, '^.+\\.[^.]+$')
              THEN regexp_extract(filename, '^(.+)\\.[^.]+$', 1) ELSE filename END AS stem,
         regexp_extract(filename, '^.+(\\.[^.]+)$', 1) AS ext,
         regexp_extract(path, '([^/]*)/[^/]*$', 1) AS gold_label
       FROM p1 WHERE {kept})"""


def _resp_ctes(late: bool = False, absent: bool = True) -> str:
    """``late``: where a request was answered again, only that answer.
    ``absent``: some requests have no response; without it, every event has one."""
    told = f"FROM events WHERE NOT ({D.RESP_ABSENT})" if absent else "FROM events"
    select = lambda cols: "SELECT " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" {told}"
    cols = dict(D.RESP_COLUMNS)
    resp = select(cols)
    if late:
        again = select({**cols, "raw_response": D.RESP_AGAIN_TEXT})
        resp = f"{resp} AND NOT ({D.RESP_AGAIN}) UNION ALL {again} AND {D.RESP_AGAIN}"
    falsy = r'^(null|false|""|\{\}|-?0(\.0*)?([eE][-+]?[0-9]+)?)$'
    return f"""
resp AS ({resp}),
rx AS (SELECT *, regexp_extract(raw_response, {q(FENCE_RE)}, 1) AS fence_txt,
              regexp_extract(raw_response, {q(BRACE_RE)}, 1) AS brace_txt FROM resp),
ry AS (SELECT *, CASE WHEN raw_response IS NULL THEN NULL
                      WHEN json_valid(raw_response) THEN 'whole'
                      WHEN fence_txt <> '' AND json_valid(fence_txt) THEN 'fence'
                      WHEN brace_txt <> '' AND json_valid(brace_txt) THEN 'braces' END AS parse_step
       FROM rx),
rz AS (SELECT *, CASE parse_step WHEN 'whole' THEN raw_response WHEN 'fence' THEN fence_txt
                      WHEN 'braces' THEN brace_txt END AS ptxt FROM ry),
rs AS (SELECT *, CASE WHEN raw_response IS NULL THEN 'null'
                      WHEN starts_with(raw_response, 'Error:') THEN 'error' ELSE 'ok' END AS response_status,
              CASE WHEN json_type(ptxt) = 'OBJECT' THEN json_extract(ptxt, '$.design_patterns') END AS kv
       FROM rz),
rt AS (SELECT *, CASE WHEN raw_response IS NULL THEN 'null'
                      WHEN parse_step IS NULL THEN 'no_json'
                      WHEN json_type(ptxt) <> 'OBJECT' THEN 'not_object'
                      WHEN kv IS NULL THEN 'no_key'
                      WHEN json_type(kv) = 'ARRAY' AND json_array_length(kv) > 0 THEN 'ok'
                      WHEN json_type(kv) = 'ARRAY' OR regexp_matches(CAST(kv AS VARCHAR), {q(falsy)}) THEN 'empty'
                      ELSE 'not_list' END AS parse_status FROM rs),
el AS (SELECT request_id, raw_response, CAST(i AS INTEGER) AS pos,
              json_extract(kv, '$[' || CAST(i AS VARCHAR) || ']') AS e
       FROM (SELECT request_id, raw_response, kv, unnest(range(CAST(json_array_length(kv) AS BIGINT))) AS i
             FROM rt WHERE parse_status = 'ok')),
valid AS (SELECT * FROM el WHERE json_type(e) = 'OBJECT'),
dets AS (
  SELECT request_id, raw_response, pos,
    CASE WHEN json_extract(e, '$.pattern') IS NULL THEN 'Unknown' ELSE json_extract_string(e, '$.pattern') END AS detected_pattern,
    CASE WHEN json_extract(e, '$.confidence') IS NULL THEN '0' ELSE json_extract_string(e, '$.confidence') END AS confidence,
    CASE WHEN json_extract(e, '$.adherence') IS NULL THEN '0' ELSE json_extract_string(e, '$.adherence') END AS adherence,
    CASE WHEN json_extract(e, '$.reason') IS NULL THEN '' ELSE json_extract_string(e, '$.reason') END AS reasoning,
    false AS is_fallback
  FROM valid
  UNION ALL
  SELECT request_id, raw_response, -1, 'None', '0', '0', {q(FALLBACK_REASON)}, true
  FROM rt WHERE request_id NOT IN (SELECT request_id FROM valid))"""


def more_oracle_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["path_label"] = "WITH " + PATHS_CTE + "," + _path_cols(SOURCE_EXTENSIONS) + """
SELECT doc_id, path, filename, stem, ext, gold_label FROM p2"""
    out["text_decode"] = """
WITH t AS (SELECT doc_id, regexp_replace(replace(text, chr(65533), ''), '\\r\\n?', chr(10), 'g') AS t
           FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS decoded_chars,
       CAST(len(string_split(t, chr(10))) AS INTEGER) AS decoded_lines, md5(t) AS decoded_md5
FROM t"""
    lm = ", ".join(f"({q(k)}, {q(v)})" for k, v in D.INDEX_LABEL_MAP.items())
    out["label_map_join"] = f"""
WITH idx AS (SELECT event_id, {D.INDEX_LABEL} AS raw_label, {D.INDEX_PROJECT} AS project,
                    {D.INDEX_CLASS} AS class_name FROM events),
m(raw, label) AS (VALUES {lm})
SELECT event_id, raw_label, label, 'DPD-' || project || '-' || class_name || '.java' AS item_name
FROM idx JOIN m ON idx.raw_label = m.raw"""
    kw_case = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(stem), {q(k)})" for k in kws)
        + f" THEN {q(label)}" for label, kws in LABEL_KEYWORDS) + " END"
    out["keyword_label"] = "WITH " + PATHS_CTE + "," + _path_cols((".java",)) + f"""
SELECT doc_id, stem, label FROM (SELECT doc_id, stem, {kw_case} AS label FROM p2)
WHERE label IS NOT NULL"""
    pref = " OR ".join(f"starts_with(x, {q(p)})" for p in PROJECT_PREFIXES)
    out["project_prefix"] = "WITH " + PATHS_CTE + "," + _path_cols((".java",)) + f""",
pp AS (SELECT doc_id, stem, string_split(substr(path, 7), '/') AS parts FROM p2),
pd AS (SELECT doc_id, stem,
              list_filter(list_slice(parts, 1, len(parts) - 1), lambda x: {pref})[1] AS first_dir
       FROM pp),
pj AS (SELECT doc_id, stem,
              coalesce(replace(regexp_extract(first_dir, '^\\s*(\\S+)', 1), ' ', '-'),
                       {q(DEFAULT_PROJECT)}) AS project FROM pd)
SELECT doc_id, project, 'PMART-' || project || '-' || stem || '.java' AS item_name FROM pj"""
    order = "md5('42' || '-' || CAST(doc_id AS VARCHAR)), doc_id"
    out["stratified_sample"] = f"""
SELECT doc_id, lang, CAST(sample_rank AS INTEGER) AS sample_rank FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS sample_rank
  FROM documents) WHERE sample_rank <= 10"""
    out["sample_then_exists"] = f"""
SELECT doc_id, lang, CAST(sample_rank AS INTEGER) AS sample_rank FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {order}) AS sample_rank
  FROM documents) s
WHERE sample_rank <= 25 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)"""
    porder = "md5('42' || '-' || CAST(p_partkey AS VARCHAR)), p_partkey"
    out["dedup_keep_first"] = f"""
WITH firsts AS (
  SELECT * FROM (SELECT p_partkey, p_name, p_type,
                        row_number() OVER (PARTITION BY p_type, p_name ORDER BY {porder}) AS r1
                 FROM part) WHERE r1 = 1),
kept AS (SELECT f.* FROM firsts f WHERE NOT EXISTS (
  SELECT 1 FROM part e WHERE e.p_size <= 2 AND e.p_type = f.p_type AND e.p_name = f.p_name))
SELECT p_type, p_name, p_partkey, CAST(sample_rank AS INTEGER) AS sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY {porder}) AS sample_rank FROM kept)
WHERE sample_rank <= 10"""
    tree = f"""
tree AS (SELECT {D.TREE_PROJECT} AS project, 'd' || CAST(doc_id AS VARCHAR) AS folder, {D.TREE_NAME} AS filename, text || chr(10) AS t
         FROM documents WHERE {D.IN_TREE})"""
    out["corpus_scan"] = f"WITH {tree}" + """
SELECT filename, folder AS gold_label, CAST(strlen(t) AS BIGINT) AS length FROM tree WHERE ends_with(filename, '.java')"""
    text = lambda t: f"regexp_replace(replace({t}, chr(65533), ''), '\\r\\n?', chr(10), 'g')"
    out["corpus_read"] = f"""
SELECT {D.SOURCE_NAME} AS filename, 'src' AS gold_label, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS content_md5
FROM (SELECT doc_id, {text("text || chr(10)")} AS t FROM documents WHERE {D.LISTED})"""
    n = D.CORPUS_SAMPLES
    of_label = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in RAW_LABEL_MAP.items())
    seeded = lambda key: f"md5('42-' || {key}), {key}"
    out["corpus_build"] = f"WITH {tree}" + f""",
idx AS (SELECT doc_id, {D.SOURCE_NAME} AS name, CASE {D.SOURCE_LABEL} {of_label} END AS label, text || chr(10) AS t,
          {D.LISTED} AS listed FROM documents WHERE {D.INDEXED}),
one AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded('name')}) AS k FROM idx WHERE label IS NOT NULL),
stems AS (SELECT '/' || project || '/' || folder || '/' || filename AS below, project, t,
            regexp_extract(filename, '^(.+)\\.java$', 1) AS stem FROM tree WHERE ends_with(filename, '.java')),
named AS (SELECT *, {kw_case} AS label, 'PMART-' || CASE WHEN {' OR '.join(f"starts_with(project, {q(x)})" for x in PROJECT_PREFIXES)}
            THEN string_split(project, ' ')[1] ELSE {q(DEFAULT_PROJECT)} END || '-' || stem || '.java' AS name FROM stems),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, name ORDER BY {seeded('below')}) AS r
           FROM named WHERE label IS NOT NULL) WHERE r = 1),
two AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded('below')}) AS k FROM firsts)
SELECT label AS gold_label, 'DPD-' || name AS filename, 'DPD' AS origin, md5({text('t')}) AS content_md5
FROM one WHERE k <= {n} AND listed
UNION ALL SELECT label, name, 'PMART', md5({text('t')}) FROM two WHERE k <= {n}"""
    out["corpus_summary"] = f"""
WITH s AS (SELECT doc_id, lang AS gold_label, {D.DOC_ORIGIN} AS origin FROM documents)
SELECT coalesce(gold_label, 'TOTAL') AS gold_label,
       CAST(count(*) FILTER (WHERE origin = 'DPD') AS BIGINT) AS dpd,
       CAST(count(*) FILTER (WHERE origin = 'PMART') AS BIGINT) AS pmart,
       CAST(count(*) AS BIGINT) AS total
FROM s GROUP BY ROLLUP (gold_label)"""
    # Written out here: (model, provider, style, temperature, max tokens) of the accepted models.
    ok = (("gpt-5", "openai", "chat", 1.0, None), ("gemini-3.0-pro", "google", "joined", None, None),
          ("llama-3.3-70b-groq", "groq", "chat", 0.2, 1024))
    sql = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else repr(v)
    rows = ["(" + ", ".join(map(sql, m)) + ")" for m in ok]
    instr = q(D.REQUEST_INSTRUCTION)
    sep = " || ".join(f"chr({ord(c)})" if c == "\n" else q(c) for c in _chunks(JOINED_PROMPT_SEPARATOR))
    out["request_build"] = f"""
WITH items AS (SELECT {D.DET_FILENAME} AS filename, text FROM documents),
models(model_name, provider, style, temperature, max_tokens) AS (VALUES {', '.join(rows)})
SELECT model_name || '/' || filename AS request_id, filename, model_name, provider,
  CAST(CASE WHEN style = 'joined' THEN 1 ELSE 2 END AS INTEGER) AS n_messages,
  CAST(CASE WHEN style = 'joined' THEN length({instr} || {sep} || text)
            ELSE length({instr}) + length(text) END AS INTEGER) AS prompt_chars,
  md5(CASE WHEN style = 'joined' THEN 'user:' || {instr} || {sep} || text
           ELSE 'system:' || {instr} || chr(10) || 'user:' || text END) AS prompt_md5,
  CAST(temperature AS DOUBLE) AS temperature, CAST(max_tokens AS INTEGER) AS max_tokens
FROM items CROSS JOIN models"""
    styles = {m[0]: m[2] for m in ok[:2]}
    sent = " ".join(f"WHEN {q(m)} THEN {instr + ' || ' + sep + ' || text' if style == 'joined' else 'text'}"
                    for m, style in styles.items())
    found = " ".join(f"WHEN contains(t, {q(w)}) THEN {q(k)}" for k, w in D.DETECTOR_KEYWORDS)
    asked = f"""
rq AS (SELECT *, lower(CASE m {sent} END) AS t FROM
  (SELECT *, {D.DET_FILENAME} AS filename FROM documents), (VALUES {', '.join(f'({q(m)})' for m in styles)}) x(m)),
an AS (SELECT m || '/' || filename AS request_id, doc_id, m, filename, lang, length(t) AS n, CASE {found} END AS k,
         CAST(CASE WHEN doc_id % 2 = 0 THEN '2025-01-01' ELSE '2025-01-02' END AS TIMESTAMP) AS started_at FROM rq)"""
    out["request_files"] = out["request_build"]
    out["index_csv"] = f"""
SELECT {D.SOURCE_LABEL} AS raw_label, 'proj' || doc_id % 17 AS Project, 'C' || doc_id AS Class FROM documents WHERE {D.INDEXED}"""
    out["detector_resume"] = "WITH " + asked + """
SELECT request_id, CASE WHEN k IS NULL THEN 'Error: no keyword' ELSE '{"design_patterns": [{"pattern": "' || k
         || '", "confidence": ' || n % 101 || '}]}' END AS raw_response,
       started_at, started_at + to_seconds(n % 60) AS ended_at FROM an"""
    out["detector_scores"] = "WITH " + _scoring_ctes(asked.replace("\nrq AS", "rq AS", 1) + """,
det AS (SELECT filename, lang AS ground_truth_label, m AS model_name, coalesce(k, 'None') AS detected_pattern,
          0.0 AS duration_seconds, doc_id AS row_no FROM an)""") + """
SELECT model_name, CAST(files_processed AS BIGINT) AS files_processed, total_tp, total_fp,
       total_fn, precision, recall, f1, total_tp AS correct_count, total_fn AS missed_count,
       total_fp AS fp_count
FROM micro_s"""
    out["detection_run"] = "WITH " + _scoring_ctes(asked.replace("\nrq AS", "rq AS", 1) + f""",
det AS (SELECT filename, lang AS ground_truth_label, m AS model_name, coalesce(k, 'None') AS detected_pattern,
          0.0 AS duration_seconds, doc_id AS row_no FROM an WHERE NOT ({D.UNREADABLE}))""") + scopes_sql()
    out["response_extract"] = "WITH " + _resp_ctes() + """
SELECT request_id, model_name, response_status, parse_step, parse_status,
       CAST(CASE WHEN json_type(kv) = 'ARRAY' THEN json_array_length(kv) END AS INTEGER) AS n_elements
FROM rt"""
    out["detection_explode"] = "WITH " + _resp_ctes(absent=False) + """
SELECT request_id, pos, detected_pattern, confidence, adherence, reasoning, is_fallback FROM dets"""
    out["detection_stream"] = out["detection_explode"]
    na = ", ".join(q(t) for t in CSV_NA_TOKENS)
    nn = lambda c: f"CASE WHEN {c} IN ({na}) THEN NULL ELSE {c} END AS {c}"
    out["csv_roundtrip"] = "WITH " + _resp_ctes() + f"""
SELECT {nn('request_id')}, {nn('raw_response')}, pos, {nn('detected_pattern')},
       {nn('confidence')}, {nn('adherence')}, {nn('reasoning')} FROM dets"""
    out["source_split"] = det_sql(f"""
SELECT filename, model_name, row_no, {sql_origin('filename')} AS origin FROM det
WHERE {sql_origin('filename')} IS NOT NULL""")
    models_first = """(SELECT string_agg(model_name, ',' ORDER BY first_row, model_name)
        FROM (SELECT model_name, min(row_no) AS first_row FROM det GROUP BY model_name))"""
    out["run_metadata"] = det_sql(f"""
SELECT 'documents' AS source_dir, CAST(count(DISTINCT filename) AS BIGINT) AS files_processed,
       {models_first} AS models_used, CAST(count(*) AS BIGINT) AS total_results,
       CAST(count(DISTINCT filename) FILTER (WHERE starts_with(filename, 'DPD-')) AS BIGINT) AS dpd_files,
       CAST(count(DISTINCT filename) FILTER (WHERE starts_with(filename, 'PMART-')) AS BIGINT) AS pmart_files,
       CAST(count(DISTINCT filename) AS BIGINT) AS files_read
FROM det""")
    out["run_summary"] = det_sql(f"""
SELECT CAST(count(*) AS BIGINT) AS rows_loaded,
       CAST((SELECT count(*) FROM (SELECT DISTINCT filename, model_name FROM det)) AS BIGINT) AS file_model_groups,
       CAST(count(DISTINCT filename) AS BIGINT) AS unique_files, {models_first} AS models
FROM det""")
    first, second, _ = D.RUN_IDS
    out["run_write"] = det_sql(f"""
, runs AS (SELECT {q(first)} AS run_id, * FROM det WHERE model_name = 'strict'
           UNION ALL SELECT {q(second)}, * FROM det),
meta AS (SELECT r.run_id, 'documents' AS source_dir, strptime(r.run_id, '%Y-%m-%d_%H-%M-%S') AS timestamp,
  count(DISTINCT filename) AS files_processed, count(DISTINCT filename) AS files_read, count(*) AS total_results,
  (SELECT string_agg(model_name, ',' ORDER BY f) FROM (SELECT model_name, min(row_no) AS f FROM runs x
     WHERE x.run_id = r.run_id GROUP BY 1)) AS models_used,
  count(DISTINCT filename) FILTER (filename LIKE 'DPD-%') AS dpd_files,
  count(DISTINCT filename) FILTER (filename LIKE 'PMART-%') AS pmart_files FROM runs r GROUP BY r.run_id)
SELECT run_id, coalesce({sql_origin('filename')}, '') AS origin, count(*) AS n_rows,
       count(DISTINCT filename) AS n_files, sum(row_no)::BIGINT AS row_no_sum, any_value(meta.source_dir) AS source_dir,
       any_value(meta.timestamp) AS timestamp, any_value(meta.files_processed) AS files_processed,
       any_value(meta.models_used) AS models_used, any_value(meta.total_results) AS total_results,
       any_value(meta.dpd_files) AS dpd_files, any_value(meta.pmart_files) AS pmart_files,
       any_value(meta.files_read) AS files_read
FROM runs JOIN meta USING (run_id) GROUP BY ALL""")
    out["latest_committed"] = "WITH " + _scoring_ctes(_det_cte().replace(
        "\ndet AS (", "\ndet_all AS (") + ", det AS (FROM det_all WHERE row_no % 32 < 16)") + """
SELECT model_name, CAST(files_processed AS BIGINT) AS files_processed, total_tp, total_fp,
       total_fn, precision, recall, f1, total_tp AS correct_count, total_fn AS missed_count,
       total_fp AS fp_count
FROM micro_s"""
    out["csv_rejects"] = f"SELECT {D.EVENT_LINE} AS record FROM events WHERE event_id % 50 IN (1, 2, 3)"
    out["latest_run"] = """
WITH runs AS (SELECT strftime(ts, '%Y-%m-%d_%H') || '-00-00' AS run_id, count(*) AS n
              FROM events GROUP BY 1)
SELECT max(run_id) AS run_id, strptime(max(run_id), '%Y-%m-%d_%H-%M-%S') AS run_started,
       CAST(arg_max(n, run_id) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_runs
FROM runs WHERE n > 0"""
    return out


def report_sql(hist: str) -> str:
    """The fixed-width report, line by line; ``hist`` are the histogram's CTEs."""
    from labelscope.functions import fixed_values as FV
    head = ", ".join(q(x) for x in FV.REPORT_TABLE_HEAD)
    columns = ", ".join(q(x) for x in FV.REPORT_COMPARISON_COLUMNS)
    targets = "[" + ", ".join(q(t) for t in D.DET_TARGETS) + "]"
    score = lambda *c: ", ".join(f"printf('%.3f', {x})" for x in c)
    row = f"printf({q(FV.REPORT_TABLE_ROW_FORMAT)}, {{}}, {{}}, {{}}, {{}}, {score('precision', 'recall', 'f1')})"
    num = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
    value = lambda c: f"CASE WHEN regexp_matches({c}, {q(num)}) THEN TRY_CAST({c} AS DOUBLE) END"
    board = f"printf({q(FV.REPORT_COMPARISON_ROW_FORMAT)}, model_name, {score('precision', 'recall', 'f1')})"
    published = ", ".join(f"({q(m)}, {p!r}::DOUBLE, {r!r}::DOUBLE, {f!r}::DOUBLE)" for m, p, r, f in PUBLISHED_SCORES)
    spread = lambda text, c: (f"printf({q(text)}, printf('%.1f', avg({c})), printf('%.0f', min({c})), "  # noqa: E731
                              f"printf('%.0f', max({c})))")
    table_head = f"printf({q(FV.REPORT_TABLE_HEAD_FORMAT)}, {head})"
    board_head = f"printf({q(FV.REPORT_COMPARISON_HEAD_FORMAT)}, {columns})"
    rule, small = q(FV.REPORT_TABLE_RULE), q(FV.REPORT_SECTION_RULE)
    joined = q("', '")
    return "WITH " + _scoring_ctes() + "," + hist + f""",
scored AS (SELECT *, {sql_prf('tp', 'fp', 'fn')} FROM counts),
top AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY n DESC, first_file, first_row, raw_label) AS k
        FROM hist_first),
missed AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY filename) AS k
           FROM verdict_x WHERE in_scope AND NOT correct),
wrong AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY filename, label) AS k
          FROM (SELECT *, unnest(detected) AS label FROM verdict_x WHERE in_scope) WHERE label <> gold_label),
sources AS (SELECT model_name, origin, count(*) FILTER (correct) AS c, count(*) AS n FROM verdict_x
            WHERE origin IS NOT NULL GROUP BY ALL),
stats AS (SELECT model_name, {spread(FV.REPORT_CONFIDENCE, value('confidence'))} AS conf,
            {spread(FV.REPORT_ADHERENCE, value('adherence'))} AS adh,
            printf({q(FV.REPORT_RESPONSE_TIME)}, printf('%.2f', sum(duration_seconds) / count(duration_seconds)),
                   printf('%.1f', sum(duration_seconds))) AS secs FROM det GROUP BY 1),
labels AS (SELECT model_name, list({row.format('label', 'tp', 'fp', 'fn')} ORDER BY list_position({targets}, label)) AS l
           FROM scored GROUP BY 1),
sections AS (
  SELECT model_name AS model, 0 AS section, [{q(FV.REPORT_RULE)}, {q(FV.REPORT_TITLE)} || upper(model_name),
    {q(FV.REPORT_RULE)}, printf({q(FV.REPORT_FILES)}, files_processed::BIGINT)] AS lines FROM micro_s
  UNION ALL SELECT model_name, 1, list_prepend({q(FV.REPORT_IGNORED_HEAD)},
    list(printf({q(FV.REPORT_IGNORED_LINE)}, raw_label, n) ORDER BY k)) FROM top WHERE k <= 5 GROUP BY 1
  UNION ALL SELECT model_name, 2, list_concat([{table_head}, {rule}], l,
    [{rule}, {row.format(q(FV.REPORT_OVERALL), 'total_tp', 'total_fp', 'total_fn')}]) FROM micro_s JOIN labels USING (model_name)
  UNION ALL SELECT model_name, 3, list_prepend({q(FV.REPORT_MISSED_HEAD)}, list(printf({q(FV.REPORT_MISSED_LINE)}, filename,
    gold_label, CASE WHEN len(detected) > 0 THEN array_to_string(detected, {joined}) ELSE 'none' END) ORDER BY k))
    FROM missed WHERE k <= 5 GROUP BY 1
  UNION ALL SELECT model_name, 4, list_prepend({q(FV.REPORT_FP_HEAD)},
    list(printf({q(FV.REPORT_FP_LINE)}, filename, gold_label, label) ORDER BY k)) FROM wrong WHERE k <= 5 GROUP BY 1
  UNION ALL SELECT model_name, 5, [{q(FV.REPORT_QUALITY_HEAD)}, {small}, conf, adh, secs] FROM stats
  UNION ALL SELECT model_name, 6, list_concat([{q(FV.REPORT_SOURCE_HEAD)}, {small}],
    list(printf({q(FV.REPORT_SOURCE_LINE)}, origin, c, n, printf('%.1f', c / n * 100)) ORDER BY origin)) FROM sources GROUP BY 1
  UNION ALL SELECT '*', 10, list_concat([{q(FV.REPORT_COMPARISON_HEAD)}, {board_head}, {rule}],
    list({board} ORDER BY f1 DESC, first_row), [printf({q(FV.REPORT_BEST)}, first(model_name ORDER BY f1 DESC, first_row),
    printf('%.3f', max(f1)))]) FROM micro_s
  UNION ALL SELECT '*', 11, list_concat([{q(FV.REPORT_PUBLISHED_HEAD)}, {board_head}, {rule}],
    list({board} ORDER BY model_name)) FROM (VALUES {published}) AS t(model_name, precision, recall, f1))
SELECT model, section, i::INTEGER AS line_no, lines[i + 1] AS line
FROM (SELECT *, unnest(range(len(lines))) AS i FROM sections)"""


def _chunks(s: str):
    """Split text into newline characters and runs of other characters."""
    buf = ""
    for ch in s:
        if ch == "\n":
            if buf:
                yield buf
                buf = ""
            yield ch
        else:
            buf += ch
    if buf:
        yield buf


def _resp_det_block() -> str:
    """``det`` built from the response relation joined back to its requests:
    the latest answers, and the fallback row of requests without one."""
    return _resp_ctes(late=True) + f""",
rq AS (SELECT {D.RESP_REQUEST_ID} AS request_id, {D.RESP_FILENAME} AS filename,
              {D.RESP_GOLD} AS gold_label, {D.RESP_MODEL} AS model_name,
              event_id AS item_no, {D.RESP_MODEL_NO} AS model_no, event_id FROM events
       WHERE NOT ({D.REQUEST_ABSENT})),
det AS (
  SELECT r.filename, r.gold_label AS ground_truth_label, r.model_name,
         coalesce(d.detected_pattern, CASE WHEN d.request_id IS NULL THEN 'None' END) AS detected_pattern,
         d.confidence, d.adherence,
         CASE WHEN d.request_id IS NOT NULL THEN CAST(r.event_id % 60 AS DOUBLE) END AS duration_seconds,
         CAST((r.item_no * 3 + r.model_no) * 1000 + coalesce(d.pos, -1) AS BIGINT) AS row_no
  FROM rq r LEFT JOIN dets d USING (request_id))"""


def response_oracle_queries() -> dict[str, str]:
    from labelscope.functions.fixed_values import DEFAULT_SYNONYMS, DEFAULT_TARGETS
    ctes = "WITH " + _scoring_ctes(_resp_det_block(), DEFAULT_SYNONYMS, DEFAULT_TARGETS)
    out = {
        "response_scores": ctes + """
SELECT model_name, CAST(files_processed AS BIGINT) AS files_processed, total_tp, total_fp,
       total_fn, precision, recall, f1, total_tp AS correct_count, total_fn AS missed_count,
       total_fp AS fp_count
FROM micro_s""",
        "response_label_scores": ctes + f"""
SELECT model_name, label, tp, fp, fn, {sql_prf('tp', 'fp', 'fn')} FROM counts""",
        "response_durations": ctes + """
SELECT model_name, round(sum(duration_seconds) / count(duration_seconds), 6) AS duration_mean_by_row,
       round(sum(duration_seconds), 6) AS duration_total_by_row,
       CAST(count(duration_seconds) AS BIGINT) AS n_rows,
       round((SELECT avg(call_duration) FROM verdict_x v WHERE v.model_name = det.model_name), 6)
         AS duration_mean_by_call,
       round((SELECT sum(call_duration) FROM verdict_x v WHERE v.model_name = det.model_name), 6)
         AS duration_total_by_call,
       (SELECT CAST(count(call_duration) AS BIGINT) FROM verdict_x v
         WHERE v.model_name = det.model_name) AS n_calls
FROM det GROUP BY model_name""",
        "response_orphans": "WITH " + _resp_ctes() + f""",
late AS (SELECT {D.RESP_REQUEST_ID} AS request_id, 1 AS n FROM events
         WHERE {D.RESP_AGAIN} AND NOT ({D.RESP_ABSENT})),
found AS (SELECT request_id, CAST(count(*) FILTER (NOT is_fallback) AS INTEGER) AS n FROM dets GROUP BY request_id),
gone AS (SELECT {D.RESP_REQUEST_ID} AS request_id FROM events WHERE {D.REQUEST_ABSENT})
SELECT request_id, response_status, parse_status, n AS n_detections, 'orphan' AS reason
FROM rt JOIN found USING (request_id) WHERE request_id IN (FROM gone)
UNION ALL SELECT request_id, 'ok', 'ok', 1, 'orphan' FROM late WHERE request_id IN (FROM gone)
UNION ALL SELECT request_id, response_status, parse_status, f.n, 'repeated'
FROM rt JOIN found f USING (request_id) JOIN late USING (request_id) WHERE request_id NOT IN (FROM gone)""",
        "response_matches": f"""
WITH a AS (SELECT *, {D.RESP_MODEL} AS m, NOT ({D.REQUEST_ABSENT}) AS asked, NOT ({D.RESP_ABSENT}) AS told,
             NOT ({D.RESP_ABSENT}) AND {D.RESP_AGAIN} AS again FROM events),
x AS (SELECT m AS model_name, CASE WHEN told THEN 'answered' ELSE 'missing' END AS match, told FROM a WHERE asked
      UNION ALL SELECT m, 'repeated', true FROM a WHERE asked AND again
      UNION ALL SELECT '', 'orphan', true FROM a WHERE NOT asked AND told
      UNION ALL SELECT '', 'orphan', true FROM a WHERE NOT asked AND again)
SELECT model_name, match, count(*) AS n, count(*) FILTER (told) AS n_answers FROM x GROUP BY ALL""",
        "response_rejects": "WITH " + _resp_ctes(absent=False) + """
SELECT request_id, pos, CAST(e AS VARCHAR) AS element, 'element_not_object' AS reason
FROM el WHERE json_type(e) <> 'OBJECT'""",
        "item_index": f"""
SELECT {D.DET_FILENAME} AS filename,
       CAST(row_number() OVER (ORDER BY {D.DET_FILENAME}) - 1 AS BIGINT) AS item_no
FROM documents""",
    }
    return out
