"""Filter interaction audit: what each filter removes in every order.

Every document gets a mask of the filters it fails (a bit for each letter), and
the masks are counted by part: a few cells, whatever the number of documents.
A recursive CTE then extends filter prefixes by each unused letter, carrying
the applied bits for every mask that occurs; each level of the recursion
emits, for its step, whether a mask is kept, removed or redundant there.
Joined to the cells that gives the documents of each step of each order, and a
filter's removals summed over all orders (its Shapley share, not divided). The
recursion works on masks, not on documents or parts: at most 2 to the number
of filters times the number of prefixes, 10,400 rows for five filters.

A filter is a SQL condition of failure over ``words``, ``distinct_words``,
``capitals``, ``chars``, ``symbol`` (holds one of ``SYMBOLS``) and ``repeated``
(the text equals that of a smaller doc_id anywhere in the table). Texts are
compared by their SHA-256; they are never shuffled.

Nulls: a null text is empty; a null part column is the empty string; a null
doc_id is smaller than no other, repeats none and has no label. Rows repeated
with one doc_id are counted each and don't repeat one another; a doc_id with
several labels has quality (toxic) 1 if one of them does. Very long texts are
measured whole. Empty tables give no rows. Other columns are ignored, and
columns of any names may be there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import stored, word_array

SYMBOLS = "#$%&*|"
#: Letter -> condition of failure.
FILTERS = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 3 * chars",
    "D": "symbol",
    "E": "repeated",
}


def _mask(filters: Mapping[str, str], repeated: bool) -> Column:
    """Bits of the filters that a document fails, if it is (not) repeated."""
    bits = F.lit(0)
    for i, condition in enumerate(filters.values()):
        fails = F.expr(condition.replace("repeated", "true" if repeated else "false"))
        bits = bits + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    return bits.cast("int")


def masks(docs: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """doc_id, part, text_key, and the mask of each document as the first of
    its text (``mask_first``) and as a later one (``mask_later``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    d = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", "text", word_array(F.col("text")).alias("w"))
    d = d.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"),
        F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"),
        F.length("text").cast("long").alias("chars"),
        (F.length("text") - F.length(F.translate("text", upper, ""))).cast("long").alias("capitals"),
        F.regexp_like("text", F.lit("[" + SYMBOLS + "]")).alias("symbol"))
    return d.select("doc_id", "part", "text_key", _mask(filters, False).alias("mask_first"),
                    _mask(filters, True).alias("mask_later"))


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those
    of toxic 1 for every part and mask that occurs.

    Documents are counted first by text, part and labels, so a text with any
    number of copies is a few rows; a text's smallest doc_id is then found over
    those rows."""
    known = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    d = masks(docs, filters, part).join(known, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    kind = ["text_key", "part", "mask_first", "mask_later", "good", "toxic"]
    by_id = d.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    lowest = by_text.groupBy(F.col("text_key").alias("key")).agg(F.min("low").alias("lowest"))
    first = F.col("n_null") + F.when(F.col("low") == F.col("lowest"), F.col("n_low")).otherwise(0)
    both = by_text.join(lowest, F.col("text_key") == F.col("key")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask_first").alias("mask"), first.alias("n")),
            F.struct(F.col("mask_later").alias("mask"), (F.col("n") - first).alias("n")))).alias("c"))
    n = F.col("c.n")
    return both.filter(n > 0).groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


#: One row for every mask and every prefix of unused letters. ``bits`` has a
#: bit for each letter, in the order of the letters.
_STEPS = """
WITH RECURSIVE steps(mask, prefix, step, applied, letter, fails, gone_before) AS (
  SELECT mask, '', 0, 0, '', 0, 0 FROM {masks}
  UNION ALL
  SELECT s.mask, concat(s.prefix, s.next.letter), s.step + 1, s.applied | s.next.bit, s.next.letter,
         s.mask & s.next.bit, s.mask & s.applied
  FROM (SELECT mask, prefix, step, applied,
               explode(filter({letters}, x -> (x.bit & applied) = 0)) AS next FROM steps) s)
SELECT mask, prefix, step, letter,
       fails = 0 AND gone_before = 0 AS kept, fails <> 0 AND gone_before = 0 AS removed,
       fails <> 0 AND gone_before <> 0 AS redundant, fails <> 0 AND mask = fails AS only
FROM steps WHERE step > 0"""


def steps(cell: DataFrame, filters: Mapping[str, str] = FILTERS) -> DataFrame:
    """(part, prefix, step, letter) with the long counts kept, removed,
    redundant, unique_fails, good_lost and toxic_lost of the prefix's last
    step. ``cell`` as given by ``cells``."""
    letters = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})"
                                   for i, x in enumerate(filters)) + ")"
    one = cell.sparkSession.sql(_STEPS.replace("{letters}", letters), masks=cell.select("mask").distinct())
    of = lambda flag, n="n": F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    # A row for each mask and prefix: bounded by the number of filters alone.
    return cell.join(F.broadcast(one), "mask").groupBy("part", "prefix", "step", "letter").agg(
        of("kept").alias("kept"), of("removed").alias("removed"), of("redundant").alias("redundant"),
        of("only").alias("unique_fails"), of("removed", "good").alias("good_lost"),
        of("removed", "toxic").alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """A row for each part, order of all filters and step: the counts of
    ``steps`` and ``shapley``, the step's filter's removals summed over all
    orders."""
    s = stored(steps(stored(cells(docs, labels, filters, part), "audit_cells"), filters), "audit_steps")
    orders = s.filter(F.length("prefix") == len(filters)).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("k"))
    out = orders.withColumn("prefix", F.expr("substring(filter_order, 1, k)")).join(s, ["part", "prefix"])
    share = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")
