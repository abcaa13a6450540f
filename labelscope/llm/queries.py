"""The operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelscope.llm import (binary_packing, conversation_repair, edit_leaks, filter_audit, line_join, odd_minhash,
                            ppm_language, pu_quality, recompression, token_counts, toxicity, url_filter, weak_rules)
from labelscope.sources.tables import load_table


def op1_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.groups(load_table(spark, sf_dir, "documents"), k=4).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.pieces(load_table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load_table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.thin_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


def op4_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_leaks.leaks(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return ppm_language.predict(docs, ppm_language.train(docs))


def op6_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load_table(spark, sf_dir, "labels")))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.line_counts(load_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed")


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load_table(spark, sf_dir, "documents"))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.quality(load_table(spark, sf_dir, "documents"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(load_table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(load_table(spark, sf_dir, "conversations"))


def op13_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_odd_minhash, op2_binary_packing, op3_blocked_bloom_urls, op4_edit_leaks, op5_ppm_language,
    op6_levenshtein_toxicity, op7_line_join, op8_trie_token_counts, op9_weak_rules, op10_recompression,
    op11_filter_audit, op12_conversation_repair, op13_pu_quality)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: CRC-32 of a short ASCII text before its last inversion, bit by bit.
_CRC = """list_reduce([4294967295::UBIGINT] || list_transform(string_split({}, ''), lambda x: ascii(x)::UBIGINT),
    lambda h, b: list_reduce([xor(h, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))"""

ORACLE_SQL: dict[str, str] = {
    "op1_odd_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w
                     FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4
        THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id, doc_id AS component FROM documents
      UNION SELECT e.x, r.component FROM r JOIN e ON e.y = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(component) AS component_id,
       min(component) = r.doc_id AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op3_blocked_bloom_urls": f"""
WITH u AS (SELECT page_id, html, coalesce(url, '') LIKE '%://%' AS ok,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
        lambda x: NOT regexp_matches(x, '^(utm_[^&=]*|ref|fbclid|gclid)(=[^&]*)?$')), '&') AS query FROM pages),
c AS (SELECT *, CASE WHEN ok THEN regexp_replace(host, '^www\\.', '')
        || regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '')
        || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
            THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
         WHEN canonical IN (SELECT canonical FROM c WHERE length(html) < {url_filter.THIN_HTML}
                            AND canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM c""",
    "op10_recompression": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT doc_id, i FROM s WHERE s IN (SELECT s FROM s GROUP BY s HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM d),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.at) AS kept FROM
      (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS at FROM w) p
      ANTI JOIN g ON g.doc_id = p.doc_id AND g.at = p.at GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(any_value(r.n), 0)::BIGINT AS n_removed,
       sha256(coalesce(any_value(k.kept), '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) r USING (doc_id) LEFT JOIN k USING (doc_id)
GROUP BY w.doc_id, w.w""",
    "op11_filter_audit": rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
f AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x:
        CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM m),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f GROUP BY ALL),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT o, k::INTEGER AS step, o[k] AS letter, string_split(o[:k - 1], '') AS before
      FROM o, range(1, 6) r(k)),
z AS (SELECT part, o AS filter_order, step, letter,
        coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, letter)), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, letter)), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = [letter]), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, letter)), 0)::BIGINT AS toxic_lost
      FROM g, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM z""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor({_CRC.format('key')}, 4294967295::UBIGINT) % 20 AS kind FROM k),
dmg AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS cut FROM dmg),
f AS (SELECT *, CASE WHEN cut = '' THEN 'blank'
                     WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                     WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) AS c, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS c0 FROM r),
mv(c, p, q) AS (VALUES ('s', '', 's'), ('u', '', 'u'), ('u', 's', 'u'), ('u', 'a', 'u'), ('a', 'u', 'a')),
ins(p, q, c, t) AS (VALUES ('', '', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('', 'u', 3, 'I'),
  ('', 'a', 6, 'II'), ('s', 'u', 3, 'I'), ('s', 'a', 6, 'II'), ('u', 'a', 3, 'I'), ('a', 'u', 3, 'I')),
ed AS (SELECT p, q, c AS c, 0 AS cost, 'K' AS t FROM mv UNION ALL
       SELECT m.p, m.q, x.c, 3, 'R' FROM mv m, (SELECT DISTINCT c FROM f) x WHERE m.c <> 's'),
e AS (SELECT conv_id, i, p, q, cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cost, t
      FROM f JOIN ed USING (c) WHERE fault IN ('', 'truncated')
      UNION ALL SELECT conv_id, i, p, p, 4, 'D' FROM f, (VALUES (''), ('s'), ('u'), ('a')) s(p)),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS s, {{'c': 0, 'a': ''}} AS b FROM conversations GROUP BY conv_id
       UNION ALL
       SELECT dp.conv_id, e.i, e.q, min({{'c': dp.b.c + ins.c + e.cost, 'a': dp.b.a || ins.t || e.t}})
       FROM dp JOIN ins ON ins.p = dp.s JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1 AND e.p = ins.q
       GROUP BY dp.conv_id, e.i, e.q),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id),
b AS (SELECT dp.conv_id, min({{'c': dp.b.c + ins.c, 'a': dp.b.a || ins.t}}) AS b
      FROM dp LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN ins ON ins.p = dp.s
      WHERE dp.i = coalesce(n.n, 0) AND ins.q IN ('', 'a') GROUP BY dp.conv_id),
x AS (SELECT conv_id, z, substr(b.a, z, 1) AS t, length(regexp_replace(substr(b.a, 1, z), 'I', '', 'g')) AS i,
             length(regexp_replace(substr(b.a, 1, z), 'D', '', 'g')) AS o
      FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS z FROM b)),
y AS (SELECT x.conv_id, x.o, x.t, CASE WHEN x.t = 'I' THEN '' ELSE f.text END AS text, f.role
      FROM x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i WHERE x.t <> 'D'),
z AS (SELECT *, max(CASE WHEN o = 1 AND t = 'K' AND role LIKE 's%' THEN 1 ELSE 0 END)
        OVER (PARTITION BY conv_id) AS sys FROM y),
g AS (SELECT conv_id, string_agg(CASE WHEN t = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
               || ':' || text, chr(10) ORDER BY o) AS fixed FROM z GROUP BY conv_id)
SELECT b.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank,
       coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
       coalesce(n.illegal, 0)::BIGINT AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit,
       sha256(coalesce(g.fixed, '')) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id""",
}
