"""Keyword tables of any size; numbers as Python prints them."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelscope.functions.numeric import fixed
from labelscope.operators import corpus as C

CHARS = "abcdefg"


def test_ten_thousand_keywords(spark):
    r = random.Random(1)
    word = lambda a, b: "".join(r.choice(CHARS) for _ in range(r.randrange(a, b)))
    keywords = [(f"l{i % 50}", word(4, 9) if i % 100 else word(1, 3) + "q", i % 700) for i in range(10_000)]
    keywords += [("one", "Z", 900), ("two", "éé", 901), ("none", "", 0), ("l1", keywords[0][1], 5)]
    stems = [word(3, 30) for _ in range(400)] + ["", "z", "xZx", "ÉÉx", "ab", "q"] + [word(3, 12)] * 3
    paths = spark.createDataFrame([(f"/p/{i}", s) for i, s in enumerate(stems)], "path string, stem string")
    table = spark.createDataFrame(keywords, "label string, keyword string, priority int")
    got = {x["path"]: x["label"] for x in C.keyword_labels_join(paths, table).collect()}
    want = {}
    for i, s in enumerate(stems):
        found = [(p, label) for label, k, p in keywords if k and k.lower() in s.lower()]
        if found:
            want[f"/p/{i}"] = min(found)[1]
    assert got == want and len(want) > 300
    plan = C.keyword_labels_join(paths, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert C.keyword_labels_join(paths, table.limit(0)).count() == 0


def test_a_hot_stem_is_looked_up_once(spark):
    paths = spark.range(5000).select(F.concat(F.lit("/p/"), "id").alias("path"), F.when(F.col("id") % 3 == 0, "MyFactoryImpl")
                                     .otherwise(F.concat(F.lit("Plain"), "id")).alias("stem"))
    table = spark.createDataFrame([("factory", "factory", 0), ("all", "plain4", 1)], "label string, keyword string, priority int")
    got = {r["label"]: r["count"] for r in C.keyword_labels_join(paths, table).groupBy("label").count().collect()}
    assert got["factory"] == 1667 and got["all"] == sum(str(i).startswith("4") for i in range(5000) if i % 3)


def texts(spark, values, digits):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r["t"] for r in df.select("i", fixed("v", digits).alias("t")).orderBy("i").collect()]


TRICKY = [0.0, 0.125, 0.375, 2.5, 3.5, 1.005, 2.675, 0.0005, 0.0625, 0.1875, 0.9995, 0.99949999999999, 0.5, 1.5, 99.95, 1e6 + .25,
          1 / 3, 2 / 3, 0.05, 0.15, 0.25, 0.35, 0.45, 5e-324, 1e15 + .5, 4503599627370497.5, 9007199254740993.0, -0.25, -1.5,
          -2.675, 1e-9, 0.3, 123456.789]


def test_tricky_numbers(spark):
    for digits in (0, 1, 2, 3):
        assert texts(spark, TRICKY, digits) == [f"{v:.{digits}f}" for v in TRICKY]
    assert texts(spark, [None, math.nan], 2) == [None, "nan"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(0, 1), st.floats(0, 1e6), st.integers(0, 10 ** 6).map(lambda n: n / 2000),
                          st.tuples(st.integers(0, 300), st.integers(1, 300)).map(lambda x: x[0] / x[1])),
                min_size=50, max_size=200), st.integers(0, 3))
def test_random_numbers(spark, values, digits):
    assert texts(spark, values, digits) == [f"{v:.{digits}f}" for v in values]
