"""Count -> score goldens (FIXTURES.md section 2): bit-equal P/R/F1."""

from collections import defaultdict

from labelscope.functions.scores import with_prf

# FIXED VALUES: the committed results, in their order: run, scope, model,
# label (OVERALL: micro-averaged), tp, fp, fn, precision, recall, F1.
GOLDENS = [
    ('2025-12-09', 'DPD', 'llama3.1-8b', 'OVERALL', 4, 3, 36, 0.5714285714285714, 0.1, 0.1702127659574468),
    ('2025-12-09', 'DPD', 'llama3.1-8b', 'singleton', 1, 1, 9, 0.5, 0.1, 0.16666666666666669),
    ('2025-12-09', 'DPD', 'llama3.1-8b', 'factory', 0, 1, 10, 0.0, 0.0, 0.0),
    ('2025-12-09', 'DPD', 'llama3.1-8b', 'observer', 3, 1, 7, 0.75, 0.3, 0.4285714285714285),
    ('2025-12-09', 'DPD', 'llama3.1-8b', 'decorator', 0, 0, 10, 0.0, 0.0, 0.0),
    ('2025-12-09', 'DPD', 'gemma3-27b', 'OVERALL', 35, 5, 5, 0.875, 0.875, 0.875),
    ('2025-12-09', 'DPD', 'gemma3-27b', 'singleton', 8, 1, 2, 0.8888888888888888, 0.8, 0.8421052631578948),
    ('2025-12-09', 'DPD', 'gemma3-27b', 'factory', 9, 0, 1, 1.0, 0.9, 0.9473684210526316),
    ('2025-12-09', 'DPD', 'gemma3-27b', 'observer', 10, 4, 0, 0.7142857142857143, 1.0, 0.8333333333333333),
    ('2025-12-09', 'DPD', 'gemma3-27b', 'decorator', 8, 0, 2, 1.0, 0.8, 0.888888888888889),
    ('2025-12-09', 'DPD', 'qwen3-14b', 'OVERALL', 29, 4, 11, 0.8787878787878788, 0.725, 0.7945205479452054),
    ('2025-12-09', 'DPD', 'qwen3-14b', 'singleton', 8, 1, 2, 0.8888888888888888, 0.8, 0.8421052631578948),
    ('2025-12-09', 'DPD', 'qwen3-14b', 'factory', 4, 1, 6, 0.8, 0.4, 0.5333333333333333),
    ('2025-12-09', 'DPD', 'qwen3-14b', 'observer', 10, 2, 0, 0.8333333333333334, 1.0, 0.9090909090909091),
    ('2025-12-09', 'DPD', 'qwen3-14b', 'decorator', 7, 0, 3, 1.0, 0.7, 0.8235294117647058),
    ('2025-12-09', 'DPD', 'deepseek-r1-14b', 'OVERALL', 35, 3, 5, 0.9210526315789473, 0.875, 0.8974358974358975),
    ('2025-12-09', 'DPD', 'deepseek-r1-14b', 'singleton', 10, 1, 0, 0.9090909090909091, 1.0, 0.9523809523809523),
    ('2025-12-09', 'DPD', 'deepseek-r1-14b', 'factory', 7, 1, 3, 0.875, 0.7, 0.7777777777777777),
    ('2025-12-09', 'DPD', 'deepseek-r1-14b', 'observer', 10, 1, 0, 0.9090909090909091, 1.0, 0.9523809523809523),
    ('2025-12-09', 'DPD', 'deepseek-r1-14b', 'decorator', 8, 0, 2, 1.0, 0.8, 0.888888888888889),
    ('2025-12-09', 'ALL', 'llama3.1-8b', 'OVERALL', 9, 3, 51, 0.75, 0.15, 0.24999999999999997),
    ('2025-12-09', 'ALL', 'llama3.1-8b', 'singleton', 4, 1, 16, 0.8, 0.2, 0.32000000000000006),
    ('2025-12-09', 'ALL', 'llama3.1-8b', 'factory', 0, 1, 20, 0.0, 0.0, 0.0),
    ('2025-12-09', 'ALL', 'llama3.1-8b', 'observer', 5, 1, 15, 0.8333333333333334, 0.25, 0.3846153846153846),
    ('2025-12-09', 'ALL', 'gemma3-27b', 'OVERALL', 53, 8, 7, 0.8688524590163934, 0.8833333333333333, 0.8760330578512396),
    ('2025-12-09', 'ALL', 'gemma3-27b', 'singleton', 16, 5, 4, 0.7619047619047619, 0.8, 0.7804878048780488),
    ('2025-12-09', 'ALL', 'gemma3-27b', 'factory', 18, 0, 2, 1.0, 0.9, 0.9473684210526316),
    ('2025-12-09', 'ALL', 'gemma3-27b', 'observer', 19, 3, 1, 0.8636363636363636, 0.95, 0.9047619047619048),
    ('2025-12-09', 'ALL', 'qwen3-14b', 'OVERALL', 41, 5, 19, 0.8913043478260869, 0.6833333333333333, 0.7735849056603774),
    ('2025-12-09', 'ALL', 'qwen3-14b', 'singleton', 12, 3, 8, 0.8, 0.6, 0.6857142857142857),
    ('2025-12-09', 'ALL', 'qwen3-14b', 'factory', 10, 0, 10, 1.0, 0.5, 0.6666666666666666),
    ('2025-12-09', 'ALL', 'qwen3-14b', 'observer', 19, 2, 1, 0.9047619047619048, 0.95, 0.9268292682926829),
    ('2025-12-09', 'ALL', 'deepseek-r1-14b', 'OVERALL', 50, 4, 10, 0.9259259259259259, 0.8333333333333334, 0.8771929824561403),
    ('2025-12-09', 'ALL', 'deepseek-r1-14b', 'singleton', 15, 3, 5, 0.8333333333333334, 0.75, 0.7894736842105262),
    ('2025-12-09', 'ALL', 'deepseek-r1-14b', 'factory', 15, 0, 5, 1.0, 0.75, 0.8571428571428571),
    ('2025-12-09', 'ALL', 'deepseek-r1-14b', 'observer', 20, 1, 0, 0.9523809523809523, 1.0, 0.975609756097561),
    ('2025-12-09', 'PMART', 'llama3.1-8b', 'OVERALL', 5, 3, 35, 0.625, 0.125, 0.20833333333333334),
    ('2025-12-09', 'PMART', 'llama3.1-8b', 'singleton', 3, 0, 7, 1.0, 0.3, 0.4615384615384615),
    ('2025-12-09', 'PMART', 'llama3.1-8b', 'factory', 0, 1, 10, 0.0, 0.0, 0.0),
    ('2025-12-09', 'PMART', 'llama3.1-8b', 'observer', 2, 2, 8, 0.5, 0.2, 0.28571428571428575),
    ('2025-12-09', 'PMART', 'llama3.1-8b', 'decorator', 0, 0, 10, 0.0, 0.0, 0.0),
    ('2025-12-09', 'PMART', 'gemma3-27b', 'OVERALL', 31, 7, 9, 0.8157894736842105, 0.775, 0.7948717948717949),
    ('2025-12-09', 'PMART', 'gemma3-27b', 'singleton', 8, 4, 2, 0.6666666666666666, 0.8, 0.7272727272727272),
    ('2025-12-09', 'PMART', 'gemma3-27b', 'factory', 9, 1, 1, 0.9, 0.9, 0.9),
    ('2025-12-09', 'PMART', 'gemma3-27b', 'observer', 9, 2, 1, 0.8181818181818182, 0.9, 0.8571428571428572),
    ('2025-12-09', 'PMART', 'gemma3-27b', 'decorator', 5, 0, 5, 1.0, 0.5, 0.6666666666666666),
    ('2025-12-09', 'PMART', 'qwen3-14b', 'OVERALL', 24, 3, 16, 0.8888888888888888, 0.6, 0.7164179104477612),
    ('2025-12-09', 'PMART', 'qwen3-14b', 'singleton', 4, 2, 6, 0.6666666666666666, 0.4, 0.5),
    ('2025-12-09', 'PMART', 'qwen3-14b', 'factory', 6, 0, 4, 1.0, 0.6, 0.7499999999999999),
    ('2025-12-09', 'PMART', 'qwen3-14b', 'observer', 9, 1, 1, 0.9, 0.9, 0.9),
    ('2025-12-09', 'PMART', 'qwen3-14b', 'decorator', 5, 0, 5, 1.0, 0.5, 0.6666666666666666),
    ('2025-12-09', 'PMART', 'deepseek-r1-14b', 'OVERALL', 27, 3, 13, 0.9, 0.675, 0.7714285714285714),
    ('2025-12-09', 'PMART', 'deepseek-r1-14b', 'singleton', 5, 2, 5, 0.7142857142857143, 0.5, 0.588235294117647),
    ('2025-12-09', 'PMART', 'deepseek-r1-14b', 'factory', 8, 0, 2, 1.0, 0.8, 0.888888888888889),
    ('2025-12-09', 'PMART', 'deepseek-r1-14b', 'observer', 10, 1, 0, 0.9090909090909091, 1.0, 0.9523809523809523),
    ('2025-12-09', 'PMART', 'deepseek-r1-14b', 'decorator', 4, 0, 6, 1.0, 0.4, 0.5714285714285715),
    ('2025-12-11', 'DPD', 'gpt-5', 'OVERALL', 33, 10, 7, 0.7674418604651163, 0.825, 0.7951807228915662),
    ('2025-12-11', 'DPD', 'gpt-5', 'singleton', 8, 1, 2, 0.8888888888888888, 0.8, 0.8421052631578948),
    ('2025-12-11', 'DPD', 'gpt-5', 'factory', 7, 6, 3, 0.5384615384615384, 0.7, 0.608695652173913),
    ('2025-12-11', 'DPD', 'gpt-5', 'observer', 10, 3, 0, 0.7692307692307693, 1.0, 0.8695652173913044),
    ('2025-12-11', 'DPD', 'gpt-5', 'decorator', 8, 0, 2, 1.0, 0.8, 0.888888888888889),
    ('2025-12-11', 'DPD', 'gemini-3.0-pro', 'OVERALL', 30, 5, 10, 0.8571428571428571, 0.75, 0.7999999999999999),
    ('2025-12-11', 'DPD', 'gemini-3.0-pro', 'singleton', 8, 1, 2, 0.8888888888888888, 0.8, 0.8421052631578948),
    ('2025-12-11', 'DPD', 'gemini-3.0-pro', 'factory', 6, 1, 4, 0.8571428571428571, 0.6, 0.7058823529411764),
    ('2025-12-11', 'DPD', 'gemini-3.0-pro', 'observer', 10, 3, 0, 0.7692307692307693, 1.0, 0.8695652173913044),
    ('2025-12-11', 'DPD', 'gemini-3.0-pro', 'decorator', 6, 0, 4, 1.0, 0.6, 0.7499999999999999),
    ('2025-12-11', 'ALL', 'gpt-5', 'OVERALL', 48, 10, 12, 0.8275862068965517, 0.8, 0.8135593220338982),
    ('2025-12-11', 'ALL', 'gpt-5', 'singleton', 12, 3, 8, 0.8, 0.6, 0.6857142857142857),
    ('2025-12-11', 'ALL', 'gpt-5', 'factory', 16, 4, 4, 0.8, 0.8, 0.8000000000000002),
    ('2025-12-11', 'ALL', 'gpt-5', 'observer', 20, 3, 0, 0.8695652173913043, 1.0, 0.9302325581395349),
    ('2025-12-11', 'ALL', 'gemini-3.0-pro', 'OVERALL', 43, 5, 17, 0.8958333333333334, 0.7166666666666667, 0.7962962962962963),
    ('2025-12-11', 'ALL', 'gemini-3.0-pro', 'singleton', 13, 2, 7, 0.8666666666666667, 0.65, 0.7428571428571429),
    ('2025-12-11', 'ALL', 'gemini-3.0-pro', 'factory', 10, 0, 10, 1.0, 0.5, 0.6666666666666666),
    ('2025-12-11', 'ALL', 'gemini-3.0-pro', 'observer', 20, 3, 0, 0.8695652173913043, 1.0, 0.9302325581395349),
    ('2025-12-11', 'PMART', 'gpt-5', 'OVERALL', 27, 6, 13, 0.8181818181818182, 0.675, 0.7397260273972603),
    ('2025-12-11', 'PMART', 'gpt-5', 'singleton', 4, 2, 6, 0.6666666666666666, 0.4, 0.5),
    ('2025-12-11', 'PMART', 'gpt-5', 'factory', 9, 0, 1, 1.0, 0.9, 0.9473684210526316),
    ('2025-12-11', 'PMART', 'gpt-5', 'observer', 10, 3, 0, 0.7692307692307693, 1.0, 0.8695652173913044),
    ('2025-12-11', 'PMART', 'gpt-5', 'decorator', 4, 1, 6, 0.8, 0.4, 0.5333333333333333),
    ('2025-12-11', 'PMART', 'gemini-3.0-pro', 'OVERALL', 23, 3, 17, 0.8846153846153846, 0.575, 0.696969696969697),
    ('2025-12-11', 'PMART', 'gemini-3.0-pro', 'singleton', 5, 1, 5, 0.8333333333333334, 0.5, 0.625),
    ('2025-12-11', 'PMART', 'gemini-3.0-pro', 'factory', 4, 0, 6, 1.0, 0.4, 0.5714285714285715),
    ('2025-12-11', 'PMART', 'gemini-3.0-pro', 'observer', 10, 2, 0, 0.8333333333333334, 1.0, 0.9090909090909091),
    ('2025-12-11', 'PMART', 'gemini-3.0-pro', 'decorator', 4, 0, 6, 1.0, 0.4, 0.5714285714285715),
]
ZERO = ((0, 0, 0), (0.0, 0.0, 0.0))


def test_goldens_bit_equal(spark):
    assert len(GOLDENS) == 84
    wanted = {r[4:7]: r[7:] for r in GOLDENS} | {ZERO[0]: ZERO[1]}
    df = spark.createDataFrame(sorted(wanted), "tp long, fp long, fn long")
    got = {(r["tp"], r["fp"], r["fn"]): (r["precision"], r["recall"], r["f1"])
           for r in with_prf(df).collect()}
    assert got == wanted


def test_overall_counts_are_the_sums_of_the_labels(spark):
    """The micro average of a grouping by model is the committed one."""
    from pyspark.sql import functions as F
    labels = [r[:7] for r in GOLDENS if r[3] != "OVERALL"]
    df = spark.createDataFrame(labels, "run string, scope string, model string, label string, tp long, fp long, fn long")
    sums = with_prf(df.groupBy("run", "scope", "model").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).collect()
    got = {(r["run"], r["scope"], r["model"]): (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in sums}
    assert got == {r[:3]: r[4:] for r in GOLDENS if r[3] == "OVERALL"}


def test_origins_add_up_where_the_targets_are_the_same():
    """Combined counts of a label are those of both origins."""
    by = defaultdict(lambda: [0, 0])
    for run, scope, model, label, tp, _, fn, *_ in GOLDENS:
        if scope != "ALL" and label not in ("OVERALL", "decorator"):
            by[run, model, label][0] += tp
            by[run, model, label][1] += fn
    for run, scope, model, label, tp, _, fn, *_ in GOLDENS:
        if scope == "ALL" and label != "OVERALL":
            assert by[run, model, label] == [tp, fn], (run, model, label)
