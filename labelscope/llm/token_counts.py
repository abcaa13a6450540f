"""Token counts under a unigram model, shared over a trie of pre-tokens.

A pre-token is a word with the word mark in front. The distinct pre-tokens of
a batch are walked in sorted order, which is the depth-first order of their
trie: the best score and the fewest tokens of a prefix are computed once for
all pre-tokens that share it, and the last value of each is its terminal
count. Workers remember terminal counts (bounded).

Scores come from the vocabulary file: piece number r has log probability
-log(r + ZIPF) (rank by rank, as in Zipf's law; the file is not trained on).
A character outside the vocabulary is as many tokens as it has bytes, at the
rarest piece's score each. Ties go to fewer tokens.

A null or empty text has no tokens. Repeated rows are counted alike, empty
tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Remembered, in_worker

VOCABULARY = "piece_bpe_32k.model"
ZIPF = 2.7
MARK = "▁"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def piece_scores(path: str) -> tuple[dict[str, float], float]:
    """piece -> log probability (not normalised), and that of a byte."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): -math.log(r + ZIPF) for r, i in enumerate(plain)}, -math.log(n + ZIPF)


def piece_endings(scores: dict[str, float]) -> dict[str, float | None]:
    """Every ending of a piece, with its score if it is a piece itself."""
    endings = {p[i:]: None for p in scores for i in range(1, len(p))}
    endings.update(scores)
    return endings


def terminal_counts(words: list[str], scores: dict[str, float], byte: float,
                    endings: dict[str, float | None] | None = None) -> list[tuple[int, float]]:
    """(tokens, score) of each of the sorted ``words``. Pieces that end at a
    character are looked for from its left on, as long as a piece ends so."""
    endings = piece_endings(scores) if endings is None else endings
    ending = endings.get
    best, last, out = [(0.0, 0)], "", []          # best[d]: (score, -tokens) of the prefix of d characters
    for word in words:
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        del best[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            c = word[end - 1]
            s, t = best[end - 1]
            if c in scores:
                top = (s + scores[c], t - 1)
            else:
                k = len(c.encode("utf-8", "replace"))
                top = (s + k * byte, t - k)
            for begin in range(end - 2, -1, -1):
                p = ending(word[begin:end], 0.0)
                if p is None:
                    continue
                if p == 0.0:                         # no piece ends so: scores are below 0
                    break
                s, t = best[begin]
                if (s + p, t - 1) > top:
                    top = (s + p, t - 1)
            best.append(top)
        last = word
        out.append((-best[-1][1], best[-1][0]))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                     ("log_score", pa.float64())])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, log_score of each document's whole text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, byte = in_worker(f"scores of {path}", lambda: piece_scores(path))
        endings = in_worker(f"endings of {path}", lambda: piece_endings(scores))
        known = in_worker(f"counts of {path}", Remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [(t or b"").split() for t in part.column(1).to_pylist()]
                known.trim()
                new = sorted((MARK + w.decode("utf-8", "replace"), w) for w in set().union(*words)
                             if w not in known and w not in known.old)
                for (_, w), v in zip(new, terminal_counts([x for x, _ in new], scores, byte, endings)):
                    known[w] = v
                rows = []
                for ws in words:
                    found = [known[w] for w in ws]
                    rows.append((len(ws), sum(f[0] for f in found), math.fsum(f[1] for f in found)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([r[j] for r in rows], _SCHEMA.field(j + 1).type) for j in range(3))],
                    schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")) \
        .mapInArrow(run, "doc_id long, n_words long, n_tokens long, log_score double")
