"""Language id by prediction by partial matching.

Each language has a context tree over bytes of order ``ORDER``: how often each
symbol followed each context of up to three symbols in its training texts. A
symbol's probability in a context with n symbols counted, d of them distinct,
is count / (n + d); an unseen one escapes to the next shorter context at
d / (n + d), down to equal shares of all symbols. The statistics are frozen:
a text's exact code length under each tree is the sum over its symbols, and
the shortest code names the language.

Symbols are the 63 bytes that are commonest in the training texts (A-Z as
a-z, white space as one) and one for all others, so a context with its symbol
is a 24-bit number. Which of the others a byte is costs its own code, after up
to three whole bytes and with the same escapes, down to equal shares of the
others: sorted tables of 32-bit runs, empty for texts of the 63 bytes. Both
together are the exact code length of the bytes.

Training takes at most ``SAMPLE_DOCS`` documents for each language, those
whose ids hash lowest. Where fewer have at most ``SAMPLE_CHARS`` characters,
longer ones follow with their first ``SAMPLE_CHARS``. Every whole text is scored.

A null text, or one without a letter, is ``und`` with score 0. Without
training rows every language is ``und``. Rows with null or empty language
don't train. Repeated rows are judged alike; ties go to the language that
sorts first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.llm.common import in_worker

ORDER = 3
SAMPLE_DOCS, SAMPLE_CHARS = 250, 20_000
UNKNOWN = "und"
_BITS, _SYMBOLS, _REST = 6, 64, 63
#: The last order + 1 bytes of a 32-bit run.
_LAST = [np.uint32((1 << 8 * (order + 1)) - 1) for order in range(ORDER + 1)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """lang, text of the training documents. Ids are ranked first (bounded for
    each language before the shuffle), then their texts are read."""
    known = docs.filter((F.length("lang") > 0) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                        & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang", (F.length("text") > SAMPLE_CHARS).alias("long")).withColumn("r", F.row_number().over(order)) \
        .filter(F.col("r") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()
    # At most SAMPLE_DOCS rows for each language.
    return known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]) \
        .select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))


def _folded(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text.lower(), np.uint8)
    return np.where((raw >= 9) & (raw <= 13), np.uint8(32), raw)


class Trees:
    """The languages' context trees, as counts of 4-symbol runs, and of
    4-byte runs that end in a byte without a symbol of its own."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        joined = {k: [_folded(t) for t in v] for k, v in texts.items()}
        seen = sum((np.bincount(t, minlength=256) for v in joined.values() for t in v), np.zeros(256, np.int64))
        common = np.argsort(-seen, kind="stable")[:_REST]
        self.symbol = np.full(256, _REST, np.uint8)
        self.symbol[np.sort(common)] = np.arange(_REST)
        self.runs = {}
        for lang, parts in joined.items():
            code, n = np.unique(np.concatenate([self.codes(p) for p in parts]), return_counts=True)
            self.runs[lang] = (code.astype(np.uint32), n.astype(np.int32))
        self.others = {}
        for lang, parts in joined.items():
            code, n = np.unique(np.concatenate([self.other_codes(p) for p in parts]), return_counts=True)
            self.others[lang] = (code, n.astype(np.int32))
        self.name = hashlib.sha256(self.symbol.tobytes() + b"".join(
            k.encode() + c.tobytes() + n.tobytes() for of in (self.runs, self.others)
            for k, (c, n) in sorted(of.items()))).hexdigest()

    def codes(self, folded: np.ndarray) -> np.ndarray:
        """Each symbol with the three before it, as 24-bit numbers; three
        spaces stand before the text."""
        s = np.concatenate([np.full(ORDER, self.symbol[32], np.uint32), self.symbol[folded].astype(np.uint32)])
        n = len(s) - ORDER
        return s[:n] << 18 | s[1:n + 1] << 12 | s[2:n + 2] << 6 | s[3:]

    def other_codes(self, folded: np.ndarray) -> np.ndarray:
        """Each byte without a symbol of its own, with the three bytes before
        it, as 32-bit numbers."""
        at = np.flatnonzero(self.symbol[folded] == _REST)
        s = np.concatenate([np.full(ORDER, 32, np.uint8), folded])
        out = np.zeros(len(at), np.uint32)
        for j in range(ORDER + 1):
            out = out << np.uint32(8) | s[at + j]
        return out

    def other_tables(self, lang: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: (runs, their bits, contexts, bits of an escape)."""
        code, n = self.others[lang]
        out = []
        for order in range(ORDER + 1):
            run, which = np.unique(code & _LAST[order], return_inverse=True)
            count = np.bincount(which, n, minlength=len(run))
            context, of = np.unique(run >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(of, count, minlength=len(context)), np.bincount(of, minlength=len(context))
            out.append((run, -np.log2(count / (total + kinds)[of]), context, -np.log2(kinds / (total + kinds))))
        return out

    @staticmethod
    def other_bits(code: np.ndarray, orders: list[tuple]) -> np.ndarray:
        """Bits of each run's last byte, given that it has no symbol."""
        bits, todo = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, -1, -1):
            run, own, context, escape = orders[order]
            if not len(run):                                  # no such byte in training
                continue
            asked = code[todo] & _LAST[order]
            at = np.minimum(np.searchsorted(run, asked), len(run) - 1)
            hit = run[at] == asked
            bits[todo[hit]] += own[at[hit]]
            todo, asked = todo[~hit], asked[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, asked), len(context) - 1)
            hit = context[at] == asked
            bits[todo[hit]] += escape[at[hit]]
        bits[todo] += np.log2(256 - _REST)
        return bits

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """(row of each 24-bit run or -1; bits of the runs seen; bits of an
        escape from each 3-symbol context; bits of a symbol after two; each
        language's ``other_tables``)."""
        union = np.unique(np.concatenate([c for c, _ in self.runs.values()]))
        row = np.full(1 << 4 * _BITS, -1, np.int32)
        row[union] = np.arange(len(union), dtype=np.int32)
        k = len(self.langs)
        bits = np.empty((len(union), k), np.float32)
        leave = np.empty((1 << 3 * _BITS, k), np.float32)
        short = np.empty((1 << 3 * _BITS, k), np.float32)
        for j, lang in enumerate(self.langs):
            code, n = self.runs[lang]
            below = np.full(_SYMBOLS, -np.log2(1 / _SYMBOLS))          # order -1
            for order in range(3):
                runs = np.bincount(code & ((1 << _BITS * (order + 1)) - 1), n,
                                   minlength=1 << _BITS * (order + 1)).reshape(-1, _SYMBOLS)
                escape, own = self._context(runs)
                below = np.tile(below.reshape(-1, _SYMBOLS), (len(runs) // max(1, below.size // _SYMBOLS), 1))
                below = np.where(runs > 0, own, escape[:, None] + below).reshape(-1)
            short[:, j] = below
            context = code >> _BITS
            total = np.bincount(context, n, minlength=1 << 3 * _BITS)
            kinds = np.bincount(context, minlength=1 << 3 * _BITS)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            bits[:, j] = leave[union >> _BITS, j] + short[union & ((1 << 3 * _BITS) - 1), j]
            bits[row[code], j] = -np.log2(n / (total + kinds)[context])
        return row, bits, leave, short, [self.other_tables(lang) for lang in self.langs]

    @staticmethod
    def _context(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, kinds = runs.sum(1), (runs > 0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            return escape, -np.log2(runs / (total + kinds)[:, None])

    def lengths(self, text: bytes, tables: tuple, step: int = 1 << 19) -> np.ndarray:
        """Code length of the text in bits under each language."""
        row, bits, leave, short, others = tables
        folded = _folded(text)
        code, out = self.codes(folded), np.zeros(len(self.langs))
        for at in range(0, len(code), step):
            c = code[at:at + step]
            r = row[c]
            out += bits[r[r >= 0]].sum(0, dtype=np.float64)
            c = c[r < 0]
            out += (leave[c >> _BITS] + short[c & ((1 << 3 * _BITS) - 1)]).sum(0, dtype=np.float64)
        code, n = np.unique(self.other_codes(folded), return_counts=True)
        if len(code):
            out += [self.other_bits(code, orders) @ n for orders in others]
        return out


def train(docs: DataFrame) -> Trees | None:
    """The trees of the bounded sample; None without training rows."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in training_sample(docs).sort("lang", F.xxhash64("text"), "text").toLocalIterator():
        texts.setdefault(lang, []).append(text.encode("utf-8", "replace"))
    return Trees(texts) if texts else None


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of the best language's
    probability) for each document."""
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                    F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters"),
                    F.col("text").cast("binary").alias("text"))
    if trees is None:
        return d.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    fields = d.schema
    out = f"doc_id {fields['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = in_worker(f"tables of {trees.name}", trees.tables)
        for batch in batches:
            langs, scores = [], []
            for letters, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                if not letters:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = trees.lengths(text.as_py(), tables)
                best = int(np.argmin(bits))
                langs.append(trees.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return d.mapInArrow(run, out)
