"""Models, providers, instruction and targets as tables of the plan."""

import json

import pytest

from labelscope.functions.fixed_values import PROVIDERS
from labelscope.operators import metrics as M
from labelscope.operators.requests import build_requests, models_table, rejected_models
from labelscope.operators.verdicts import DETECTION_SCHEMA, file_verdicts
from labelscope.sources import csv_io
from labelscope.sources.config import instruction_table, load_instruction, load_models

MODELS = [{"name": f"m{i}", "provider": ["OpenAI", "google", "nope", None, "groq"][i % 5], "model_id": "x"} for i in range(30)]


def test_files_of_models_and_instruction(spark, tmp_path):
    (tmp_path / "models.json").write_text(json.dumps(MODELS, indent=1))
    (tmp_path / "prompt.txt").write_text("\n find {it} \n\n")
    items = spark.createDataFrame([("f", "g", "c"), ("h", "g", None)], "filename string, gold_label string, content string")
    models, text = load_models(spark, f"{tmp_path}/models.json"), instruction_table(spark, f"{tmp_path}/prompt.txt")
    got = build_requests(items, models, text).collect()
    want = build_requests(items, MODELS, "find {it}").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 36
    assert [r["name"] for r in models_table(spark, models).orderBy("model_no").collect()] == [m["name"] for m in MODELS]
    assert {r["name"] for r in rejected_models(spark, models).collect()} == {m["name"] for m in MODELS if (
        m["provider"] or "").lower() not in PROVIDERS}
    plan = build_requests(items, models, text)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan
    assert load_instruction(spark, f"{tmp_path}/prompt.txt") == "find {it}"
    (tmp_path / "two").mkdir()
    for x in "ab":
        (tmp_path / "two" / f"{x}.txt").write_text(x)
    with pytest.raises(Exception, match="not one instruction file"):
        load_instruction(spark, f"{tmp_path}/two")
    for read in (load_models, instruction_table):
        with pytest.raises(FileNotFoundError):
            read(spark, f"{tmp_path}/none")


def test_no_model_and_many_models(spark):
    items = spark.createDataFrame([("f", "g", "c")], "filename string, gold_label string, content string")
    with pytest.raises(ValueError):
        build_requests(items, [{"name": "a", "provider": "nope"}], "i")
    with pytest.raises(ValueError):
        models_table(spark, items)
    none = spark.createDataFrame([("a", "nope", "x")], "name string, provider string, model_id string")
    assert build_requests(items, none, "i").count() == 0
    many = spark.range(12_000).selectExpr("concat('m', id) AS name", "'groq' AS provider", "'x' AS model_id")
    assert build_requests(items, many, "i").select("model_no").distinct().count() == 12_000


def test_scopes_from_a_table(spark):
    rows = [(f"{o}-{i}", g, "m", d, "1", "1", "", "", 1.0, n) for n, (o, i, g, d) in enumerate(
        [("DPD", 1, "a", "a"), ("DPD", 2, "b", "a"), ("PMART", 1, "c", "c"), ("PMART", 2, "a", "d"), ("X", 1, "a", "a")])]
    v = file_verdicts(spark.createDataFrame(rows, DETECTION_SCHEMA), {}, ["a", "b", "c", "d"])
    table = spark.createDataFrame([("a", None), ("b", None), ("c", "PMART"), ("d", "PMART"), ("d", "PMART")],
                                  "label string, scope string")
    got = sorted(map(str, M.scores_by_scope(v, table).collect()))
    assert got == sorted(map(str, M.scores_by_scope(
        v, {"ALL": ["a", "b"], "PMART": ["a", "b", "c", "d"]}).collect())) and len(got) == 3 + 2 + 2 + 4
    only = spark.createDataFrame([("c", "PMART")], "label string, scope string")        # nothing for all scopes
    assert {(r["scope"], r["level"]) for r in M.scores_by_scope(v, only).collect()} == {
        ("ALL", "micro"), ("DPD", "micro"), ("PMART", "micro"), ("PMART", "label")}


def test_index_keeps_na_labels(spark, tmp_path):
    index = spark.createDataFrame([("NA", "p", "c"), ("None", "null", "n/a"), ("", "x", " y ")], "raw_label string, Project string, Class string")
    path = csv_io.write_csv(index, f"{tmp_path}/index")
    schema = "raw_label string, Project string, Class string"
    kept = {tuple(r) for r in csv_io.read_csv(spark, path, schema, na_tokens=None).collect()}
    assert {("NA", "p", "c"), ("None", "null", "n/a")} <= kept and any(r[1:] == ("x", " y ") for r in kept)
    assert {r["raw_label"] for r in csv_io.read_csv(spark, path, schema).collect()} == {None}
