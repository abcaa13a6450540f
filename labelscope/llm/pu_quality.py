"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled quality 1; everything else, labelled
0 or not labelled at all, is only unlabelled web text. Each text gives
``MEASURES`` (of its whole length), cut at quantiles over all unlabelled
documents; a document is then one indicator for each measure, and the score
function g adds one weight for each.

With the squared loss the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

depends on the data only through the indicators' means and how often two occur
together, over positives and over unlabelled documents. Spark counts these
over all rows; they are a table of fixed size, from which the driver finds the
weights: where the second part would be negative the step goes against it, as
the non-negative estimator demands. Nothing is sampled.

The class prior is estimated from the same indicators: a least-squares
contrast of positives and unlabelled documents is fitted on either half of the
rows (by a hash of their measures, so copies stay together) and counted on the
other half in ``SCORE_BINS`` intervals. The prior is the least ratio of the
two shares above a score, moved by a standard error each: unlabelled text
holds at least the prior's share of any region of positives.

(g + 1) / 2, within 0 and 1, estimates the probability of quality; a document
is predicted 1 from ``FLAG`` on. Documents whose crc32(doc_id) mod 4 is 2 are
neither positives nor unlabelled text.

A null text is empty, and empty texts are scored like all others. A doc_id
with labels 1 and 0 is no positive; null labels and ids say nothing. Without
positives all score 0.5. Very long texts are measured whole. Repeated rows are
scored alike; ties of measures fall in one interval; empty tables give no
rows; other columns are ignored, and columns of any names may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import shingles, stored, word_names
from labelscope.llm.ppm_language import held_out

FLAG = 0.7
#: Where the measures are cut: these shares of all unlabelled documents.
CUTS = (0.01, 0.02, 0.04, 0.07, 0.11, 0.17, 0.5, 0.83, 0.9, 0.94, 0.97, 0.985, 0.995)
SCORE_BINS = 400
#: The penalty on squared weights is this over the root of the number of
#: positives; the prior's two shares move by this many standard errors.
RIDGE, ERRORS = 0.1, 1.0
STEPS = 400
MEASURES = ("words", "word_length", "symbols", "capitals", "digits", "marks", "shouts", "doubled", "distinct",
            "repeated_windows", "repeated_lines", "line_length")


def _class(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in characters])


_SYMBOL, _MARK, _DIGIT, _UPPER = _class("#*$%&|<>"), _class(".,;:!?"), _class("0123456789"), np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True


def measures(text: bytes) -> list[float]:
    """The measures of a text in the order of ``MEASURES``; shares are of its
    words, lines or bytes."""
    data = np.frombuffer(text, np.uint8)
    names, _ = word_names(text)
    n, kinds = len(names), np.bincount(data, minlength=256)
    if n == 0:
        return [0.0] * len(MEASURES)
    in_words = len(data) - int(kinds[9:14].sum() + kinds[32])
    # Capitals of the Latin-1 letters: C3 80 to C3 9E in UTF-8.
    upper = int(kinds[_UPPER].sum()) + int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).sum())
    windows = shingles(names, 3)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [float(np.log1p(n)), in_words / n, int(kinds[_SYMBOL].sum()) / n, upper / in_words,
            int(kinds[_DIGIT].sum()) / in_words, int(kinds[_MARK].sum()) / n, int(kinds[ord("!")]) / n,
            float((names[1:] == names[:-1]).sum()) / n, len(np.unique(names)) / n,
            1 - len(np.unique(windows)) / len(windows), 1 - len(set(lines)) / len(lines), len(data) / len(lines)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the array ``m`` of measures for every document."""
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "m"])

    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, m array<double>")


class Cuts:
    """Quantile cuts of each measure; a document's indicators."""

    def __init__(self, cuts: list[list[float]]):
        self.cuts = [np.asarray(c) for c in cuts]
        self.start = np.cumsum([0] + [len(c) + 1 for c in cuts])

    def on(self, m: np.ndarray) -> np.ndarray:
        """(documents, measures): the number of the indicator that is on. A
        value equal to a cut lies above it."""
        return np.stack([np.searchsorted(c, m[:, i], "right") + self.start[i] for i, c in enumerate(self.cuts)], 1)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(MEASURES))


def find_cuts(unlabelled: DataFrame) -> Cuts:
    aggs = [F.percentile_approx(F.col("m")[i], list(CUTS), 1000).alias(f"q{i}") for i in range(len(MEASURES))]
    row = unlabelled.agg(*aggs).first()              # one row of fixed width
    return Cuts([sorted(set(q or ())) for q in row])


def _together(rows: DataFrame, cuts: Cuts) -> np.ndarray:
    """How often two indicators are on in one document: for either half, of
    the positives and of all rows. Each batch counts in numpy, Spark adds up."""
    d = int(cuts.start[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                positive, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                on = cuts.on(_rows(batch.column(0)))
                pair = on[:, :, None] * d + on[:, None, :]
                for w in range(4):
                    x = pair[(half == w // 2) & (positive | (w % 2 == 1))]
                    total[w] += np.bincount(x.ravel(), minlength=d * d).reshape(d, d)
        which, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(i), pa.array(j), pa.array(total[which, i, j])],
                                         names=["w", "i", "j", "n"])

    out = np.zeros((4, d, d))
    counted = rows.select("m", "positive", "half").mapInArrow(run, "w long, i long, j long, n long") \
        .groupBy("w", "i", "j").agg(F.sum("n").alias("n"))
    for r in counted.collect():                      # at most 4 d^2 rows, d the number of indicators
        out[r.w, r.i, r.j] = r.n
    return out.reshape(2, 2, d, d)


# The driver's few small matrices do without BLAS: its threads don't survive
# the forks of a process that also starts a JVM, and a call can then wait forever.

def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a * x).sum(-1)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of a symmetric positive matrix, by Gauss-Jordan elimination."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], 1)
    for i in range(n):
        both[i] /= both[i, i]
        others = both[:, i].copy()
        others[i] = 0
        both -= others[:, None] * both[i]
    return both[:, n:]


class Risk(NamedTuple):
    """Second moments and means of the indicators, positives and unlabelled."""
    p2: np.ndarray
    p1: np.ndarray
    u2: np.ndarray
    u1: np.ndarray
    ridge: float

    def parts(self, w: np.ndarray) -> tuple[float, float, float]:
        """E_P[l(g)], E_P[l(-g)], E_U[l(-g)] of the loss (1 - g)^2 / 4."""
        p, u = _times(_times(self.p2, w), w), _times(_times(self.u2, w), w)
        mean_p, mean_u = _times(self.p1, w), _times(self.u1, w)
        return (p - 2 * mean_p + 1) / 4, (p + 2 * mean_p + 1) / 4, (u + 2 * mean_u + 1) / 4


def moments(p: np.ndarray, u: np.ndarray) -> Risk:
    """From joint counts; an indicator's own count is on the diagonal."""
    n_p, n_u = (np.trace(x) / len(MEASURES) for x in (p, u))
    return Risk(p / n_p, np.diag(p) / n_p, u / n_u, np.diag(u) / n_u, RIDGE / n_p ** 0.5)


def contrast(r: Risk) -> np.ndarray:
    """Least squares of +1 for positives against -1 for unlabelled text."""
    return _times(_inverse((r.p2 + r.u2) / 2 + r.ridge * np.eye(len(r.p1))), (r.p1 - r.u1) / 2)


def least_ratio(p: np.ndarray, u: np.ndarray) -> float:
    """The class prior from counts of positives and unlabelled documents in
    intervals of rising score."""
    n_p, n_u = p.sum(), u.sum()
    above_p, above_u = np.cumsum(p[::-1]) / n_p, np.cumsum(u[::-1]) / n_u
    error = lambda x, n: ERRORS * np.sqrt(x * (1 - x) / n)
    ok = above_p >= 0.2
    ratio = (above_u + error(above_u, n_u))[ok] / (above_p - error(above_p, n_p))[ok]
    return float(np.clip(ratio.min(), 0.01, 0.99))


def minimise(r: Risk, prior: float) -> np.ndarray:
    """Weights of least non-negative risk. Steps are scaled by the unlabelled
    moments; where the estimated risk on negatives is below zero, the step
    raises it instead. The best weights seen are returned."""
    scale = _inverse(r.u2 / 2 + r.ridge * np.eye(len(r.u1)))
    w = _times(scale, prior * r.p1 - r.u1 / 2)            # least risk without the bound at zero
    best, least = w, np.inf
    for _ in range(STEPS):
        pos, neg_p, neg_u = r.parts(w)
        risk = prior * pos + max(0.0, neg_u - prior * neg_p) + r.ridge * (w * w).sum() / 2
        if risk < least:
            best, least = w, risk
        up, uu = _times(r.p2, w), _times(r.u2, w)
        low = (uu + r.u1) / 2 - prior * (up + r.p1) / 2
        step = -low if neg_u < prior * neg_p else prior * (up - r.p1) / 2 + low + r.ridge * w
        w = w - 0.1 * _times(scale, step)
    return best


class Model(NamedTuple):
    cuts: Cuts
    weights: np.ndarray
    prior: float

    def probability(self, m: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[self.cuts.on(m)].sum(1) + 1) / 2, 0, 1)


def _score_counts(rows: DataFrame, cuts: Cuts, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positives and all rows in intervals of the score, each half by its weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, SCORE_BINS), np.int64)
        for batch in batches:
            if batch.num_rows:
                positive, half = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                s = np.stack(weights)[half[:, None], cuts.on(_rows(batch.column(0)))].sum(1)
                at = np.clip((s + 1) / 2 * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)
                n[1] += np.bincount(at, minlength=SCORE_BINS)
                n[0] += np.bincount(at[positive], minlength=SCORE_BINS)
        which, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(at), pa.array(n[which, at])], names=["w", "at", "n"])

    out = np.zeros((2, SCORE_BINS))
    for r in rows.select("m", "positive", "half").mapInArrow(run, "w long, at long, n long").groupBy("w", "at") \
            .agg(F.sum("n").alias("n")).collect():   # at most 2 * SCORE_BINS rows
        out[r.w, r["at"]] = r.n
    return out[0], out[1]


def train(m: DataFrame, labels: DataFrame) -> Model | None:
    """The model of measured documents (as given by ``measured``) and labels
    (doc_id, quality); None without positives."""
    trusted = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("low")).filter("low = 1").select("doc_id", F.lit(True).alias("positive"))
    rows = stored(m.filter("not held_out").join(trusted, "doc_id", "left")
                  .select("m", F.coalesce("positive", F.lit(False)).alias("positive"),
                          F.pmod(F.xxhash64("m"), F.lit(2)).cast("int").alias("half")), "pu_rows")
    if not rows.filter("positive").take(1):
        return None
    cuts = find_cuts(rows)
    halves = _together(rows, cuts)
    r = moments(*halves.sum(0))
    # A half without positives teaches nothing: then all rows do.
    of_other = [contrast(moments(*h) if h[0].any() else r) for h in halves[::-1]]
    prior = least_ratio(*_score_counts(rows, cuts, of_other))
    return Model(cuts, minimise(r, prior), prior)


def score(m: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each measured document."""
    kind = m.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.probability(_rows(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    out = m.select("doc_id", "held_out", F.lit(0.5).alias("score")) if model is None \
        else m.select("doc_id", "held_out", "m").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= FLAG).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on and score all documents; texts are read once."""
    m = stored(measured(docs), "pu_measures")
    return score(m, train(m, labels))
