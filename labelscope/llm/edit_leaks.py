"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``ERRORS`` of its length in edits. It is cut
into one piece more than that budget, so an occurrence within the budget holds
at least one piece unchanged. An Aho-Corasick automaton finds the pieces in
the documents; around each piece that is found, Myers' bit-parallel distance
says how many edits the item needs there.

Texts and items are compared in lower case with runs of white space as one
space. The items go through the driver in blocks of at most ``BLOCK_CHARS``
characters (or one item), each block over all documents. A block's result is
written before the next one is searched, and a Python worker keeps the latest
block's automaton only, so the driver holds two blocks and a worker one.
Items shorter than ``SHORTEST`` characters must occur unchanged and as whole
words: no letter, mark or digit goes on at either end (in scripts written
without spaces any place will do). Equal items are all reported.

Null and empty texts have no leaks; null items and ids, and items of white space
only, are left out of the items, a null doc_id is reported as such. Repeated rows give rows each. Empty
tables give no rows. Other columns are ignored; ``clean`` returns the input's.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import in_worker, stored

ERRORS = 0.06
SHORTEST = 24
BLOCK_CHARS = 4_000_000
#: Thai to Myanmar, Khmer, kana, Han: words follow each other without spaces.
UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, errors: float = ERRORS) -> int:
    return int(len(item) * errors) if len(item) >= SHORTEST else 0


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    n = budget(item, errors) + 1
    edges = [len(item) * j // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def least_edits(item: str, text: str) -> tuple[int, int]:
    """(distance, end): the fewest edits that turn the item into some part of
    the text, and where that part ends first. Myers' bit vectors, one
    arbitrarily long integer for each column."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        vertical = eq | minus
        eq |= ((eq & plus) + plus) ^ plus
        h_plus = minus | full & ~(eq | plus)
        h_minus = plus & eq
        score += (h_plus & last > 0) - (h_minus & last > 0)
        if score < best:
            best, end = score, j
        h_plus = h_plus << 1 & full
        h_minus = h_minus << 1 & full
        plus = h_minus | full & ~(vertical | h_plus)
        minus = h_plus & vertical
    return best, end


def goes_on(a: str, b: str) -> bool:
    """Both characters (or none) belong to one word."""
    return all(c and unicodedata.category(c)[0] in "LMN" and not UNSPACED.match(c) for c in (a, b))


class Block:
    """Items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick
        self.items, self.errors = items, errors
        held: dict[str, list[tuple[int, int]]] = {}
        texts: dict[str, list[int]] = {}
        for item_id, text in items:
            texts.setdefault(text, []).append(item_id)
        self.texts = list(texts.items())
        for i, (text, _) in enumerate(self.texts):
            for offset, piece in pieces(text, errors):
                held.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in held.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, edits, end in the normal form of the text) for each item
        that occurs within its budget, at its closest place."""
        text, best, seen = normal(text), {}, set()
        for end, (length, at) in self.automaton.iter(text):
            for i, offset in at:
                item = self.texts[i][0]
                k, start = budget(item, self.errors), end - length + 1 - offset
                if best.get(i, (1,))[0] == 0 or (i, start) in seen:
                    continue
                if len(item) < SHORTEST:
                    if not (goes_on(text[start - 1:start], item[0]) or goes_on(item[-1], text[end + 1:end + 2])):
                        best[i] = (0, end + 1)
                    continue
                seen.add((i, start))
                low = max(0, start - k)
                if text.startswith(item, max(0, start)):
                    best[i] = (0, max(0, start) + len(item))
                    continue
                edits, to = least_edits(item, text[low:start + len(item) + k])
                if edits <= k and edits < best.get(i, (k + 1,))[0]:
                    best[i] = (edits, low + to)
        return [(item_id, *best[i]) for i in sorted(best) for item_id in self.texts[i][1]]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The usable items in normal form, a bounded block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    for item_id, text in rows.sort("item_id", "text").toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def _with_next(found: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether another one follows."""
    block = next(found, None)
    while block is not None:
        after = next(found, None)
        yield block, after is not None
        block = after


def _name(items: list[tuple[int, str]], errors: float) -> str:
    return hashlib.sha256(repr((items, errors)).encode()).hexdigest()


def _latest(name: str, make) -> Block:
    """The worker's block; the one before it is forgotten first."""
    held = in_worker("leaks", dict)
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, most: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, allowed, found_to: a row for each document and
    item that it holds."""
    out = "doc_id long, item_id long, edits long, allowed long, found_to long"
    schema = pa.schema([(c.split()[0], pa.int64()) for c in out.split(", ")])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(items: list[tuple[int, str]]):
        allowed = {i: budget(t, errors) for i, t in items}

        name = _name(items, errors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _latest(name, lambda: Block(items, errors))
            for batch in batches:
                rows = [(doc, item, edits, allowed[item], to) for doc, text in
                        zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid
                        for item, edits, to in block.leaks(text.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64())
                                                  for j in range(5)], schema=schema)
        return run

    result = d.sparkSession.createDataFrame([], out)
    for n, (items, more) in enumerate(_with_next(blocks(benchmark, most))):
        found = d.mapInArrow(search(items), out)
        found = stored(found, "leaks") if more else found
        result = result.unionByName(found) if n else found
    return result


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, most: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a leak, with the input's columns. Of all blocks
    but the last, the names of the leaking texts are written."""
    def leaky(items: list[tuple[int, str]]):
        name = _name(items, errors)

        def run(texts: pd.Series) -> pd.Series:
            block = _latest(name, lambda: Block(items, errors))
            return texts.map(lambda x: x is not None and bool(block.leaks(x))).astype(bool)
        return F.pandas_udf(run, "boolean")("text")

    key, gone, left = "__llm_text", None, docs
    for items, more in _with_next(blocks(benchmark, most)):
        if more:
            now = stored(docs.filter(leaky(items)).select(F.xxhash64("text").alias(key)).distinct(), "leaky_texts")
            gone = now if gone is None else gone.unionByName(now)
        else:
            left = docs.filter(~leaky(items))
    if gone is None:
        return left
    return left.withColumn(key, F.xxhash64("text")).join(gone, key, "left_anti").select(*docs.columns)
