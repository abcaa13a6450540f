"""op13: counts against numpy, the estimator against its definition, held-out accuracy, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import pu_quality as P
from labelscope.llm.ppm_language import held_out

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, m string, positive string, low string"


def prose(r, n=120):
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randrange(2, 9))) + r.choice(["", "", "", ".", ","])
                    for _ in range(n)).capitalize()


def junk(r, n=120):
    w = r.choice(["#$ ", "SHOUT!! ", "again again again "])
    return "".join(w if r.random() < .8 else r.choice(["one ", "two "]) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        good = r.random() < .75
        rows.append((i, (prose if good else junk)(r), "en", "s", "clash", "clash", "clash"))
        if r.random() < .5:
            marks.append((i, int(good)))
    rows += [(2000, None, None, None, None, None, None), (2001, "", "en", "s", "c", "c", "c"),
             (2002, " \n\t", "en", "s", "c", "c", "c"), (2003, prose(r, 30_000), "en", "s", "c", "c", "c"),
             (2004, "x" * 200_000, "en", "s", "c", "c", "c"), (None, prose(r), "en", "s", "c", "c", "c"), rows[0], rows[0]]
    marks += [(None, 1), (2000, None), (5000, 1), marks[0], (2004, 1), (2004, 0)]
    return (spark.createDataFrame(rows, SCHEMA),
            spark.createDataFrame([(d, q, 0) for d, q in marks], "doc_id long, quality int, toxic int"), rows, dict(marks))


def test_joint_counts_and_cuts(spark, made):
    docs, labels, rows, marks = made
    m = P.measured(docs)
    data = m.filter("not held_out").select("m", (F.col("doc_id") % 3 == 0).alias("positive"),
                                           F.length(F.col("m")[0].cast("string")) % 2).toDF("m", "positive", "half").fillna(False)
    cuts = P.find_cuts(data)
    counts = P._together(data, cuts)
    got = data.collect()
    on = cuts.on(np.array([r.m for r in got]))
    want = np.zeros_like(counts)
    for r, x in zip(got, on):
        for w in ([0, 1] if r.positive else [1]):
            want[r.half, w][np.ix_(x, x)] += 1
    assert (counts == want).all() and counts[:, 0].any((1, 2)).all()
    assert (np.diff(cuts.start) == [len(c) + 1 for c in cuts.cuts]).all() and (on >= cuts.start[:-1]).all()
    a, b = P._score_counts(data, cuts, [np.zeros(counts.shape[-1])] * 2)
    assert b.sum() == len(got) and a.sum() == sum(r.positive for r in got)


def test_measures_by_hand():
    m = dict(zip(P.MEASURES, P.measures("Ab ab ab, 12!\n\nAb ab ab, 12!\nÉ #".encode())))
    assert m["words"] == pytest.approx(np.log1p(10)) and m["symbols"] == .1 and m["marks"] == .4 and m["shouts"] == .2
    assert m["capitals"] == pytest.approx(3 / 23) and m["digits"] == pytest.approx(4 / 23)
    assert m["doubled"] == 0 and m["distinct"] == .6 and m["repeated_lines"] == pytest.approx(1 / 3)
    assert P.measures(b"a a a b")[P.MEASURES.index("doubled")] == .5
    assert P.measures(b"") == P.measures(b" \n") == [0.0] * len(P.MEASURES)


def test_risk_and_minimum():
    r = np.random.default_rng(1)
    x_p, x_u = r.integers(0, 2, (400, 5)).astype(float), r.integers(0, 2, (900, 5)).astype(float)
    risk = P.Risk(x_p.T @ x_p / 400, x_p.mean(0), x_u.T @ x_u / 900, x_u.mean(0), 1e-4)
    w = r.normal(size=5)
    loss = lambda z: ((1 - z) ** 2 / 4).mean()
    assert np.allclose(risk.parts(w), (loss(x_p @ w), loss(-(x_p @ w)), loss(-(x_u @ w))))

    def total(w, prior):
        pos, neg_p, neg_u = risk.parts(w)
        return prior * pos + max(0, neg_u - prior * neg_p) + risk.ridge * (w @ w) / 2

    for prior in (.3, .7, .95):
        best = P.minimise(risk, prior)
        for _ in range(300):
            assert total(best, prior) <= total(best + r.normal(size=5) * .02, prior) + 2e-3


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_of_a_known_mixture(prior):
    r = np.random.default_rng(2)
    n = 40_000
    good = r.random(n) < prior
    s = np.where(good, r.beta(6, 2, n), r.beta(2, 6, n) * .9)
    p = r.beta(6, 2, n)
    count = lambda x: np.bincount((x * P.SCORE_BINS).astype(int), minlength=P.SCORE_BINS)[:P.SCORE_BINS]
    assert abs(P.least_ratio(count(p), count(s)) - prior) < .05


def test_edge_cases(spark, made):
    docs, labels, rows, marks = made
    got = P.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= P.FLAG) for r in got)
    first = {r.doc_id: r.score for r in got}
    assert all(first[r.doc_id] == r.score for r in got)
    right = [r.predicted == (t is not None and rows[r.doc_id][1] == t and t[1:].islower() and "#" not in t and "again" not in t)
             for r in got if r.doc_id is not None and r.doc_id < 600 for t in [rows[r.doc_id][1]]]
    assert sum(right) >= .97 * len(right)
    assert P.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in P.classify(docs, labels.limit(0)).collect()} == {0.5}
    # Held-out labels, and columns other than the text, say nothing.
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("text"))
    assert {r.doc_id: r.score for r in P.classify(moved, other).collect()} == first


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = P.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    tp = sum(r.predicted == r.quality == 1 for r in got)
    assert tp >= .95 * sum(r.quality for r in got) and tp >= .95 * sum(r.predicted for r in got)
    assert sum(r.predicted == r.quality for r in got) >= .95 * len(got)
