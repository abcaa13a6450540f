"""Substring dedup by recompression: every word covered by a window of
``WINDOW`` words whose word sequence also starts elsewhere is removed.

Recompression names a text's symbols round by round: first runs of one token,
then, in each round, pairs of neighbours. Each symbol falls on a left or a
right side by its name and the round; a left symbol followed by a right one
becomes a pair. A name is a 64-bit function of what it stands for, so all
tasks give equal strings equal names without exchanging any. Whether two
neighbours join depends on these two alone: at a cut, only the first symbol
(if it is right) and the last (if it is left) may join something outside.
So each window has a certain part, at each level, that is parsed alike wherever
the window occurs. Its anchor is the longest symbol of its certain part at
the highest level that has one; equal windows have equal anchors.

1. Spark counts the anchors' names. A window whose anchor occurs once in the
   corpus occurs once.
2. Shared anchors are compared with their context, all words that windows
   with this anchor can reach. If anchor and context occur again, all windows
   of the anchor do.
3. For the other shared anchors, the windows themselves are counted, against
   one occurrence of each context.

Names and contexts are 64 bits, windows 96 bits. Removal is judged on the
input. Null texts have no words. Repeated rows (equal id and text) are
separate occurrences, so their windows repeat. Texts shorter than a window
keep all words. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import likely, mix, names_of, stored, text_key

WINDOW = 35
ROUNDS = 4
GROUP_BYTES = 200_000                # of texts that are parsed together in a task, at least one
_U = np.uint64
_RUN, _PAIR = _U(0x8CB92BA72F3D8DD7), _U(0xABC98388FB8FAC03)
_SIDES = np.random.default_rng(35).integers(0, 1 << 63, 64, np.uint64)
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
_END = _U(0x165667B19E3779F9)


class Prefix:
    """Polynomial names of any range of a sequence."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        n = len(names)
        inverse = _U(pow(int(base), -1, 1 << 64))
        power = np.concatenate([[_U(1)], np.cumprod(np.full(n, base))])
        self.back = np.concatenate([[_U(1)], np.cumprod(np.full(n, inverse))])
        self.sum = np.concatenate([[_U(0)], np.cumsum(names * power[:n])])

    def range(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def anchors(names: np.ndarray, begin: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, words, name) of the anchor of each window of ``names`` that
    starts at one of ``begin``."""
    symbol, start = names, np.arange(len(names) + 1)
    left, right = begin.copy(), begin + window
    levels = [(symbol, start, left, right)]
    for r in range(rounds):
        if r == 0:                                            # runs of one token
            new = np.ones(len(symbol), bool)
            new[1:] = symbol[1:] != symbol[:-1]
            at = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            size = np.diff(np.append(at, len(symbol))).astype(np.uint64)
            # The first and last run of a window may go on outside.
            left, right = of[left] + 1, of[right - 1]
            symbol = np.where(size > 1, mix(symbol[at] + size * _RUN), symbol[at])
            start = np.append(start[at], start[-1])
            right = np.maximum(left, right)
        side = mix(symbol ^ _SIDES[r]) >> _U(63) == 1     # on the right
        joins = np.zeros(len(symbol), bool)                   # with the next symbol
        joins[:-1] = ~side[:-1] & side[1:]
        second = np.zeros(len(symbol), bool)
        second[1:] = joins[:-1]
        at = np.flatnonzero(~second)
        of = np.cumsum(~second) - 1
        some = left < right
        a, b = left[some], right[some]
        a = a + side[a]                                       # a right symbol may join one before
        b = b - ~side[b - 1]                                  # a left symbol may join one after
        full = a < b
        left, right = np.zeros_like(left), np.zeros_like(right)
        keep = np.flatnonzero(some)[full]
        left[keep], right[keep] = of[a[full]], of[b[full] - 1] + 1
        first = symbol[at]
        paired = joins[at]
        follow = symbol[np.minimum(at + 1, len(symbol) - 1)]
        symbol = np.where(paired, mix(first * _PAIR + mix(follow)), first)
        start = np.append(start[at], start[-1])
        levels.append((symbol, start, left, right))

    position, words, name = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), _U)
    todo = np.ones(len(begin), bool)
    for symbol, start, left, right in reversed(levels):
        who = np.flatnonzero(todo & (left < right))
        if not len(who):
            continue
        todo[who] = False
        length = np.diff(start)
        weight = length.astype(np.uint64) << _U(56) | symbol >> _U(8)   # the longest, then the greatest name
        lo, hi = left[who], right[who]
        best, top = lo.copy(), weight[lo]
        for j in range(1, int((hi - lo).max())):
            i = np.minimum(lo + j, hi - 1)
            more = weight[i] > top
            best, top = np.where(more, i, best), np.where(more, weight[i], top)
        position[who], words[who], name[who] = start[best], length[best], symbol[best]
    return position, words, name


class Group:
    """Texts parsed together: names of the words, and the windows."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        names, self.sizes = names_of(texts)
        # A name of its own after each text; no window reaches over it.
        self.names = np.insert(names, np.cumsum(self.sizes), _END)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1      # where each text begins
        count = np.maximum(self.sizes - window + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), count)           # of each window
        self.start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.window = window

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, at, name, context) of the distinct anchors; ``at`` packs the
        anchor's first window and how many windows lie from it to the last
        one. Ties can put another anchor's window between them: that one is
        inside the context too, so what holds for the context holds for it."""
        if not len(self.doc):
            return self.doc, self.start, np.zeros(0, _U), np.zeros(0, _U)
        position, words, anchor = anchors(self.names, self.first[self.doc] + self.start, self.window)
        new = np.ones(len(position), bool)
        new[1:] = (position[1:] != position[:-1]) | (words[1:] != words[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(position)) - 1
        _, one, which = np.unique(position[first] * 64 + words[first], return_index=True, return_inverse=True)
        end = np.zeros(len(one), np.int64)
        np.maximum.at(end, which, self.start[last])
        pick = first[one]
        doc, pos, words = self.doc[pick], position[pick], words[pick]
        low, high = self.first[doc], self.first[doc] + self.sizes[doc]
        a, b = np.maximum(pos + words - self.window, low), np.minimum(pos + self.window, high)
        p = Prefix(self.names, _BASE)
        context = mix(p.range(a, pos) * _PAIR + p.range(pos, b))
        return doc, self.start[pick] * 64 + end - self.start[pick] + 1, anchor[pick], context

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.first[self.doc[which]] + self.start[which]
        one, two = (Prefix(self.names, b).range(begin, begin + self.window) for b in (_BASE, _BASE2))
        return one.view(np.int64), (two >> _U(32)).astype(np.uint32).view(np.int32)


def _inside(at: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` positions, whether a window of the places ``at`` starts there."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at // 64, 1)
    np.add.at(change, at // 64 + at % 64, -1)
    return np.cumsum(change[:-1]) > 0


def _grouped(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, about GROUP_BYTES at a time."""
    for batch in batches:
        begin, size, held = 0, 0, []
        for i, t in enumerate(batch.column(text)):
            held.append(t.as_py() or b"")
            size += len(held[-1]) + 1
            if size >= GROUP_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(begin, i + 1 - begin), held
                begin, size, held = i + 1, 0, []


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _grouped(batches, 1):
        doc, at, name, context = Group(texts).places()
        yield pa.RecordBatch.from_arrays(
            [pa.array(name.view(np.int64)), part.column(0).take(pa.array(doc)), pa.array(at),
             pa.array(context.view(np.int64))], names=["name", "row", "at", "context"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, row, start, n): n occurrences in the group under one row; the
    others of a window found twice in a group have n = 0: they are settled."""
    for part, texts in _grouped(batches, 1):
        group = Group(texts)
        marked = [_inside(np.asarray(at, np.int64), max(n - WINDOW + 1, 0))
                  for n, at in zip(group.sizes.tolist(), part.column(2).to_pylist())]
        which = np.flatnonzero(np.concatenate(marked))
        h, g = group.windows(which)
        order = np.lexsort((g, h))
        h, g, which = h[order], g[order], which[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        n = np.zeros(len(h), np.int32)
        n[at] = np.diff(np.append(at, len(h)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h), pa.array(g), part.column(0).take(pa.array(group.doc[which])),
             pa.array(group.start[which], pa.int32()), pa.array(n)], names=["h", "g", "row", "start", "n"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_RESULT = ["row", "n_removed", "kept_sha256", "kept"]


def _results(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _grouped(batches, 1):
            removed, digest, kept = [], [], []
            for text, whole, starts in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                words = text.split()
                whole, starts = (np.asarray(x or [], np.int64) for x in (whole, starts))
                change = np.zeros(len(words) + 1, np.int64)
                for begin, n in ((whole // 64, whole % 64), (starts, 1)):
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + n + WINDOW - 1, -1)
                covered = np.cumsum(change[:-1]) > 0
                left = [w for w, c in zip(words, covered.tolist()) if not c]
                removed.append(int(covered.sum()))
                digest.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(kept, pa.string())], names=_RESULT)
    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(t.as_py() or b"").split() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
             pa.array([_digest(w) for w in words], pa.string())], names=["doc_id", "row", "n_words", "whole_sha256"])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay,
    joined by spaces, or null without ``with_text`` or if all stay)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    text_key(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text"))
    found = stored(d.select("row", "text").mapInArrow(_places, "name long, row long, at long, context long"), "found")
    shared = found.groupBy("name").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("name")
    alive = stored(found.join(shared, "name"), "anchors")
    contexts = alive.groupBy("name", "context").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("low"))
    # Names all of whose occurrences have one context need no windows counted.
    mixed = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("contexts")).select("name", "contexts")
    places = stored(alive.join(contexts, ["name", "context"]).join(mixed, "name").select(
        "row", "at", (F.col("k") > 1).alias("whole"),
        ((F.col("contexts") > 1) & ((F.col("k") == 1) | (F.col("row") == F.col("low")))).alias("count")), "places")
    ask = stored(places.filter("count").groupBy("row").agg(F.collect_set("at").alias("at")), "counted")
    texts = likely(d.select("row", "text"), "row", ask).join(ask, "row").select("row", "text", "at")
    windows = stored(texts.mapInArrow(_windows, "h long, g int, row long, start int, n int"), "windows")
    again = windows.filter("n > 0").groupBy("h", "g").agg(F.sum("n").alias("k")).filter("k > 1").select("h", "g")
    # n = 0: settled in the group; n > 0: the group's first, or its only one.
    repeated = windows.filter("n = 0").select("row", "start").unionByName(
        windows.filter("n > 0").join(again, ["h", "g"]).select("row", "start"))
    marks = places.filter("whole").groupBy("row").agg(F.collect_set("at").alias("whole")) \
        .join(repeated.groupBy("row").agg(F.collect_set("start").alias("starts")), "row", "full")
    marks = stored(marks, "marks")
    changed = likely(d.select("row", "text"), "row", marks).join(marks, "row").dropDuplicates(["row"]) \
        .select("row", "text", "whole", "starts").mapInArrow(
            _results(with_text), "row long, n_removed long, kept_sha256 string, kept string")
    return d.select("doc_id", "row", "text").mapInArrow(
        _whole, "doc_id long, row long, n_words long, whole_sha256 string").join(changed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept")
