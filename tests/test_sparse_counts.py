"""Confusion counts from labels that occur, with many targets, tables of targets and synonyms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from labelscope.functions.labels import MAX_INLINE_SYNONYMS
from labelscope.operators import metrics as M
from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts, unkeyed_rows

TARGETS = [f"t{i:03d}" for i in range(300)]


def rows(seed=4, items=120):
    r, out, n = random.Random(seed), [], 0
    for i in range(items):
        gold = r.choice([*TARGETS[:5], TARGETS[63], TARGETS[64], TARGETS[299], "other"])
        for model in ("a", "b"):
            for label in r.choices([*TARGETS[:6], TARGETS[62], TARGETS[63], TARGETS[64], TARGETS[127], TARGETS[128],
                                    TARGETS[299], "Alias", "other", None], k=r.randrange(1, 5)):
                out.append((f"DPD-{i}", gold, model, label, "1", "1", "", "", 1.0, n))
                n += 1
    out.append(("DPD-x", "other", "c", "other", "1", "1", "", "", 1.0, n))           # a model without any target
    out.append((None, TARGETS[0], "a", TARGETS[0], "1", "1", "", "", 1.0, n + 1))
    return out


def by_hand(rows, targets, out_of_scope=False):
    of = {}
    for f, gold, model, label, *_ in rows:
        if f is not None:
            of.setdefault((model, f), (gold, set()))[1].add({"Alias": "t001"}.get(label, label))
    out = {(m, t): [0, 0, 0] for m in {m for m, _ in of} for t in targets}
    for (model, _), (gold, found) in of.items():
        found &= set(targets)
        if gold in targets:
            out[model, gold][0 if gold in found else 2] += 1
        if gold in targets or out_of_scope:
            for t in found - {gold}:
                out[model, t][1] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def det(spark):
    return spark.createDataFrame(rows(), DETECTION_SCHEMA)


def counts(df):
    return {(r["model_name"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in df.collect()}


SYN = {"alias": "t001"}


@pytest.mark.parametrize("n", [3, 64, 65, 300])
def test_counts_by_hand(det, n):
    targets = TARGETS[:n] if n < 300 else TARGETS
    v = file_verdicts(det, SYN, targets)
    assert counts(M.confusion_counts(v, targets)) == by_hand(rows(), targets)
    assert counts(M.confusion_counts(v, targets, count_fp_out_of_scope=True)) == by_hand(rows(), targets, True)
    micro = {r["model_name"]: (r["total_tp"], r["total_fp"], r["total_fn"], r["files_processed"])
             for r in M.micro_scores(v, targets).collect()}
    want = by_hand(rows(), targets)
    for m in "abc":
        assert micro[m][:3] == tuple(sum(v[i] for (k, _), v in want.items() if k == m) for i in range(3))
    assert [micro[m][3] for m in "abc"] == [120, 120, 1]
    assert all(r["detected"] == sorted(set(r["detected"])) for r in v.collect())


def test_tables_of_targets_and_synonyms(spark, det):
    targets = spark.createDataFrame([(t,) for t in TARGETS] + [(TARGETS[0],)], "label string")
    syn = spark.createDataFrame([("alias", "t001"), ("alias", "t001")], "raw string, label string")
    v = file_verdicts(det, syn, targets)
    assert counts(M.confusion_counts(v, targets)) == by_hand(rows(), TARGETS)
    plain = file_verdicts(det, SYN, TARGETS)
    cols = ["model_name", "filename", "gold_label", "detected", "n_rows", "first_row", "origin", "in_scope", "correct"]
    assert sorted(map(str, v.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    many = {f"s{i}": "t002" for i in range(MAX_INLINE_SYNONYMS + 1)} | SYN
    assert counts(M.confusion_counts(file_verdicts(det, many, TARGETS), TARGETS)) == by_hand(rows(), TARGETS)


def test_unkeyed_rows(det):
    assert [r["row_no"] for r in unkeyed_rows(det).collect()] == [rows()[-1][-1]]


def test_scopes_with_their_own_targets(det):
    v = file_verdicts(det, SYN, TARGETS)
    got = M.scores_by_scope(v, {"ALL": TARGETS[:5], "DPD": TARGETS[60:66]}).collect()
    of = lambda s: {(r["model_name"], r["label"]): (r["tp"], r["fp"], r["fn"])
                    for r in got if r["scope"] == s and r["level"] == "label"}
    assert of("ALL") == by_hand(rows(), TARGETS[:5]) and of("DPD") == by_hand(rows(), TARGETS[60:66])
    assert sum(r["level"] == "micro" for r in got) == 6


def test_many_targets_cost_little_more(spark):
    n = 200_000
    det = spark.range(n).select(
        F.concat(F.lit("DPD-"), "id").alias("filename"), F.element_at(F.array(*map(F.lit, TARGETS[:3])), (F.col("id") % 3 + 1)
                                                                    .cast("int")).alias("ground_truth_label"),
        F.lit("m").alias("model_name"), F.element_at(F.array(*map(F.lit, TARGETS[:3])), (F.col("id") % 2 + 1).cast("int"))
        .alias("detected_pattern"), F.lit(1.0).alias("duration_seconds"), F.col("id").alias("row_no"))

    def seconds(targets):
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            M.confusion_counts(file_verdicts(det, {}, targets), targets).collect()
            best = min(best, time.perf_counter() - t)
        return best

    few, many = seconds(TARGETS[:3]), seconds(TARGETS)
    assert many < 2 * few + 1, (few, many)
