"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces whose lengths are
powers of two: whole sequences of ``SEQUENCE`` first, then the binary digits
of the rest, the longest first. Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding; pieces of one length share
a bucket, from which batches of equal shape are read.

A null or empty text is the end id alone. Repeated rows are packed each.
Empty tables give no pieces. Other columns are ignored. Long texts are
tokenised word by word (the tokenizer drops white space, so a text's ids are
its words' ids in order), and workers remember words: a bounded number of
short ones, so that their memory does not grow with what they have read.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Remembered, in_worker

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """The powers of two that n is cut into."""
    out = [sequence] * (n // sequence)
    rest = n % sequence
    return out + [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if rest >> b & 1]


#: Marks after a word that the tokenizer keeps together, apart from the word.
MARKS = ".,!?;:*$%&#"
#: How the file's vocabulary writes bytes: visible Latin-1 as itself, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip((b for b in range(256) if b not in _SHOWN), map(chr, range(256, 512))))


#: Words, and letter runs or marks, after which the older half is forgotten;
#: longer ones (of so many bytes or characters) are not remembered at all.
HELD_WORDS, HELD_PARTS, LONGEST = 100_000, 150_000, 64


class WordTokens(Remembered):
    """word (bytes) -> its ids as little-endian unsigned 32-bit.

    Letters with marks after them are cut here, as the file's pre-tokenizer
    cuts them, and only new letter runs are merged by the model; any other
    word, any letter above Latin Extended-B, and letters whose lower case is
    not letters only (capital dotted I), take the whole tokenizer.

    Most words of a text's tail come once. So a word is remembered from the
    second time on that its letters are met; the first time, its letters are."""

    def __init__(self, path: str):
        super().__init__(limit=HELD_WORDS)
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts = Remembered(limit=HELD_PARTS)

    def __missing__(self, word: bytes) -> bytes:
        ids, met = self.old.pop(word, None), True
        if ids is None:
            ids, met = self._word(word)
        if met and len(word) <= LONGEST:
            self[word] = ids
        return ids

    def _part(self, part: str) -> tuple[bytes, bool]:
        """Its ids, and whether they were known."""
        if not part:
            return b"", True
        ids = self.parts.get(part)
        if ids is not None:
            return ids, True
        ids = self.parts.old.pop(part, None)
        met = ids is not None
        if not met:
            ids = self._merged(part)
        if len(part) <= LONGEST:
            self.parts[part] = ids
        return ids, met

    def _merged(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _word(self, word: bytes) -> tuple[bytes, bool]:
        """Its ids, and whether to remember them."""
        text = word.decode("utf-8", "replace")
        plain = text if word.isascii() else unicodedata.normalize("NFC", text)
        body = plain.rstrip(MARKS)
        low = body.lower()
        if body.isalpha() and max(body) < "\u0250" and low.isalpha():
            ids, met = self._part(low)
            return ids + self._part(plain[len(body):])[0], met
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), True

    def trim(self) -> None:
        super().trim()
        self.parts.trim()


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "offset long, bucket int, ids binary")


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """A row for each piece; ``ids`` are its unsigned 32-bit little-endian ids.
    ``path`` is the tokenizer file, which every executor must have."""
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    path = path or tokenizer_path()
    end = np.asarray([END_ID], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64()),
                        ("bucket", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = in_worker(f"ids of {path}", lambda: WordTokens(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids_, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[list] = [[] for _ in schema]
                for doc, text in zip(ids_, texts):
                    known.trim()
                    ids = b"".join(map(known.__getitem__, (text or b"").split())) + end
                    total, start = len(ids) // 4, 0
                    for n in piece_lengths(total, sequence):
                        cut = ids[4 * start:4 * (start + n)]
                        for col, v in zip(rows, (doc, start, n, zlib.crc32(cut), total, 0, n.bit_length() - 1,
                                                 cut if with_ids else None)):
                            col.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, _SCHEMA)
    # Unique, and the same again if a task is repeated: input splits are fixed.
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each piece length, so a reader gets equal shapes."""
    packed.write.partitionBy("bucket").parquet(path)
