"""Findings of round three: whole inputs, collections of many files, bounded batches."""

import datetime
import itertools

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from labelscope.llm.token_counts import piece_endings, terminal_counts
from labelscope.operators.detector import run_pending
from labelscope.sources.corpus import read_items, scan_files, write_items


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A table of 3200 events, of which some ids are those of RESP_ABSENT."""
    root = tmp_path_factory.mktemp("events")
    rows = [(i, datetime.datetime(2025, 1, 1, 0, i % 60), i % 7, ("view", "click", "purchase")[i % 3], float(i)) for i in range(3200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double") \
        .coalesce(1).write.parquet(f"{root}/events.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["detection_explode", "detection_stream", "response_rejects"])
def test_every_event_has_its_response(spark, events, name):
    got = E.queries()[name](spark, events)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{events}/events.parquet/*.parquet')")
    want = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))
    ids = {r["request_id"] for r in got.collect()}
    if name == "response_rejects":
        assert "req-3120" in ids                   # 3120 % 89 = 5
    else:
        assert ids == {f"req-{i}" for i in range(3200)}


def test_collection_of_files_lies_in_its_folders_and_is_listed_by_few_tasks(spark, tmp_path):
    items = spark.createDataFrame(
        [("a b", "x'y[1]^.java", "one\r\n"), (None, "n.java", None), ("", "é#.java", ""), ("k=v", "twice.java", "t"), ("k=v", "twice.java", "t")],
        "gold_label string, filename string, content string").repartition(1)
    for mode in ("overwrite", "overwrite", "ignore"):
        root = write_items(items, f"file://{tmp_path}/own", mode=mode)
    (items.withColumnsRenamed({"filename": "name", "content": "value"}).write.partitionBy("gold_label", "name").text(f"{tmp_path}/spark"))
    found = lambda r: sorted(tuple(x) for x in read_items(spark, r, layout="folder").drop("path").collect())
    assert found(root) == found(f"{tmp_path}/spark") and len(found(root)) == 4
    many = spark.range(300).selectExpr("'l' gold_label", "concat('f', id, '.java') filename", "'x' content")
    key, tracker = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.statusTracker()
    before = spark.conf.get(key, None)
    write_items(many, f"{tmp_path}/many")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        files = scan_files(spark, f"{tmp_path}/many", layout="folder")
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
        stages = [tracker.getStageInfo(i) for j in jobs for i in j.stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert files.count() == 300 and spark.conf.get(key, None) == before
    assert 0 < max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    with pytest.raises(Exception, match="(?i)exists"):
        write_items(many, f"{tmp_path}/many", mode="error")


def test_detector_gets_bounded_batches(spark, tmp_path):
    def detector(pdf):
        return pd.DataFrame({"request_id": pdf["request_id"], "raw_response": f"Error: {len(pdf)}",
                             "started_at": pd.Timestamp("2025-01-01"), "ended_at": pd.Timestamp("2025-01-01")})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    requests = spark.range(3000).selectExpr("concat('r', id) request_id", "repeat('x', 100) messages").coalesce(1)
    for retry in (False, True):
        got = run_pending(requests, detector, f"{tmp_path}/answers", retry_errors=retry).collect()
        assert len(got) == 3000 and {r["raw_response"] for r in got} <= {f"Error: {n}" for n in range(1, 501)}
    assert spark.conf.get(key) == before


def test_pieces_are_found_by_their_endings():
    scores, byte = {"a": -1.0, "b": -2.0, "ab": -2.5, "bab": -0.5, "abab": -4.0, "éa": -1.5, "_a": -0.1}, -9.0

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            c = word[end - 1]
            k = 1 if c in scores else len(c.encode())
            found = [(best[end - 1][0] + scores.get(c, k * byte), best[end - 1][1] - k)]
            found += [(best[i][0] + scores[word[i:end]], best[i][1] - 1) for i in range(end) if word[i:end] in scores]
            best.append(max(found))
        return -best[-1][1], best[-1][0]

    words = sorted("".join(w) for n in range(6) for w in itertools.product("ab_é", repeat=n))
    assert terminal_counts(words, scores, byte) == [plain(w) for w in words]
    # Where no piece ends so, nothing longer is looked up.
    asked = []

    class Endings(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    terminal_counts(["zzzzzzzzzz"], scores, byte, Endings(piece_endings(scores)))
    assert len(asked) == 9                             # one for each character but the first
