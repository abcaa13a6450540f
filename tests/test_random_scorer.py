"""Random detection tables against counts by set algebra: partitioning and
row order must not change any result."""

import random

from labelscope.functions.fixed_values import DEFAULT_TARGETS
from labelscope.operators import metrics as M
from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts

#: Spelling -> the target it stands for, by hand.
STANDS_FOR = {"Singleton": "singleton", "singleton pattern": "singleton", " Factory Method": "factory",
              "abstract factory": "factory", "Observer": "observer", "pub-sub": "observer", "OBSERVER": "observer",
              "Decorator": None, "Wrapper": None, "None": None, "": None, None: None, "Strategy": None, " none ": None}
SPELLINGS = list(STANDS_FOR)
GOLDS = {"singleton": "singleton", "factory": "factory", "observer": "observer", "decorator": None,
         "Singleton": "singleton"}


def by_sets(rows):
    """model -> {target: (tp, fp, fn)} from the sets of (item, label) pairs."""
    out = {}
    for model in "abc":
        first = {}
        for r in sorted((r for r in rows if r[2] == model), key=lambda r: -r[9]):
            first[r[0]] = GOLDS[r[1]]
        gold = {(f, g) for f, g in first.items() if g}
        found = {(r[0], STANDS_FOR[r[3]]) for r in rows if r[2] == model and first[r[0]] and STANDS_FOR[r[3]]}
        size = lambda pairs, t: sum(label == t for _, label in pairs)
        out[model] = {t: (size(gold & found, t), size(found - gold, t), size(gold - found, t)) for t in DEFAULT_TARGETS}
        out[model]["files"] = len(first)
    return out


def test_random_tables(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = []
        n = 0
        for f in range(60):
            gold = rng.choice(list(GOLDS))
            for m in ("a", "b", "c"):
                for _ in range(rng.randint(1, 4)):
                    n += 1
                    rows.append((f"{rng.choice(['DPD', 'PMART', 'Z'])}-{f}.java", gold, m,
                                 rng.choice(SPELLINGS), "1", "1", "", None, 1.0, n))
        expected = by_sets(rows)
        shuffled = rows[:]
        rng.shuffle(shuffled)
        df = spark.createDataFrame(shuffled, DETECTION_SCHEMA).repartition(3 + trial)
        v = file_verdicts(df)
        got = {}
        for r in M.confusion_counts(v).collect():
            got.setdefault(r["model_name"], {})[r["label"]] = (r["tp"], r["fp"], r["fn"])
        for r in M.micro_scores(v).collect():
            got[r["model_name"]]["files"] = r["files_processed"]
        assert got == expected
