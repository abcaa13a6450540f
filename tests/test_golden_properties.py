"""
where every file has an origin."""

import random

from labelscope.operators import metrics as M
from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts
from tests.test_random_scorer import GOLDS, SPELLINGS


def test_golden_properties(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for f in range(80):
        gold = rng.choice(list(GOLDS))
        origin = rng.choice(["DPD", "PMART"])
        for m in ("a", "b"):
            for _ in range(rng.randint(1, 3)):
                n += 1
                rows.append((f"{origin}-{f}.java", gold, m, rng.choice(SPELLINGS),
                             "1", "1", "", None, 1.0, n))
    v = file_verdicts(spark.createDataFrame(rows, DETECTION_SCHEMA)).cache()
    micro = {r["model_name"]: r for r in M.micro_scores(v).collect()}
    labels = M.label_scores(v).collect()
    src = M.source_accuracy(v).collect()
    scopes = M.scores_by_scope(v).collect()
    in_scope = {r["model_name"]: r["c"] for r in v.where("in_scope").groupBy("model_name")
                .count().withColumnRenamed("count", "c").collect()}
    for m, r in micro.items():
        mine = [x for x in labels if x["model_name"] == m]
        # G2 totals are sums over labels
        assert r["total_tp"] == sum(x["tp"] for x in mine)
        assert r["total_fp"] == sum(x["fp"] for x in mine)
        assert r["total_fn"] == sum(x["fn"] for x in mine)
        # G3 evidence counts equal the totals
        assert (r["correct_count"], r["missed_count"], r["fp_count"]) == \
            (r["total_tp"], r["total_fn"], r["total_fp"])
        # G4 breakdown correct sums to total_tp (every file has an origin)
        assert sum(x["correct"] for x in src if x["model_name"] == m) == r["total_tp"]
        # G5 tp + fn = files whose gold is a target
        assert r["total_tp"] + r["total_fn"] == in_scope[m]
        # G6 / G7 combined against per-origin scopes
        for lab in ("singleton", "factory", "observer"):
            def get(scope, key, lab=lab):
                return sum(x[key] for x in scopes if x["scope"] == scope and x["model_name"] == m
                           and x["label"] == lab)
            for key in ("tp", "fn"):
                assert get("ALL", key) == get("DPD", key) + get("PMART", key)
            assert get("ALL", "fp") <= get("DPD", "fp") + get("PMART", "fp")
