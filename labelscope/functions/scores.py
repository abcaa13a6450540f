"""Precision / recall / F1 with zero guards, in the reference's order of
operations (so results are bit-equal to the plain-Python formulas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def precision(tp, fp) -> Column:
    tp, fp = _c(tp), _c(fp)
    return F.when((tp + fp) > 0, tp.cast("double") / (tp + fp)).otherwise(F.lit(0.0))


def recall(tp, fn) -> Column:
    tp, fn = _c(tp), _c(fn)
    return F.when((tp + fn) > 0, tp.cast("double") / (tp + fn)).otherwise(F.lit(0.0))


def f1_score(p, r) -> Column:
    p, r = _c(p), _c(r)
    return F.when((p + r) > 0, F.lit(2.0) * (p * r) / (p + r)).otherwise(F.lit(0.0))


def with_prf(df, tp="tp", fp="fp", fn="fn"):
    """Add precision, recall, f1 columns from count columns."""
    return (df.withColumn("precision", precision(tp, fp))
              .withColumn("recall", recall(tp, fn))
              .withColumn("f1", f1_score("precision", "recall")))
