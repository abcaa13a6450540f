"""What the operators hand to Python workers loads and runs without the repository."""

import subprocess
import sys

import pyarrow as pa
from pyspark import cloudpickle

from labelscope.llm import (binary_packing, conversation_repair, odd_minhash, ppm_language, pu_quality, recompression,
                            token_counts)

RUN = """
import pickle, sys
import pyarrow as pa
sys.path = [p for p in sys.path if "repo" not in p]
for f, data in pickle.load(open(sys.argv[1], "rb")):
    batches = pa.ipc.open_stream(data).read_all().to_batches()
    print(sum(b.num_rows for b in f(iter(batches))))
try:
    import labelscope
    print("the repository is on the path")
except ImportError:
    pass
"""


def test_functions_run_where_the_repository_is_not(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "One line here.\nAnother line, of words.", "en"), (2, "ein Text und der Rest", "de"),
                                  (3, None, "en")], "doc_id long, text string, lang string")
    conv = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b")],
                                 "conv_id long, turn long, role string, text string")
    found, frame = [], type(docs)
    real = frame.mapInArrow

    def kept(self, f, *args, **kwargs):
        found.append((self, f))
        return real(self, f, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", kept)
    odd_minhash.features(docs, 5)
    odd_minhash.parities(docs.selectExpr("doc_id AS node", "cast(coalesce(text, '') AS binary) AS text"), 5)
    pu_quality.measured(docs)
    conversation_repair.repair(conv)
    binary_packing.pieces(docs)
    token_counts.token_counts(docs)
    ppm_language.predict(docs, ppm_language.train(docs))
    recompression.remove_repeats(docs)
    monkeypatch.undo()
    assert len(found) >= 9
    work = []
    for df, f in found:
        sink, table = pa.BufferOutputStream(), df.toArrow()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        work.append((f, sink.getvalue().to_pybytes()))
    (tmp_path / "work").write_bytes(cloudpickle.dumps(work))
    got = subprocess.run([sys.executable, "-I", "-c", RUN, str(tmp_path / "work")], cwd=tmp_path, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-2000:]
    assert "on the path" not in got.stdout and len(got.stdout.split()) == len(found)
