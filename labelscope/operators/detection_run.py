"""A whole detection run in one call: ask, collect, commit, score.

Every step leaves a table under the base folder, so a run that dies is started
again with the same run id and goes on: requests that are answered are not
asked again, and the results of the run are seen only when it is committed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.fixed_values import DEFAULT_TARGETS, ORIGINS, PROVIDERS
from labelscope.operators.detector import Detector, run_pending
from labelscope.operators.evaluate import evaluate
from labelscope.operators.ordering import dense_index
from labelscope.operators.requests import ModelsArg, ProvidersArg, build_requests
from labelscope.operators.responses import REQUEST_COLUMNS, detection_rows
from labelscope.operators.runs import commit_run, new_run_id, read_run
from labelscope.operators.verdicts import SynonymsArg


def detection_run(items: DataFrame, models: ModelsArg, instruction: str | DataFrame, detector: Detector, base: str,
                  source_dir: str = "", run_id: str | None = None, waves: int = 1,
                  providers: ProvidersArg = PROVIDERS, targets: Sequence[str] = DEFAULT_TARGETS,
                  synonyms: SynonymsArg = None, origins: Sequence[str] = ORIGINS,
                  scopes: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Run ``detector`` with every model on every item, commit the run under
    ``base`` and score it. Returns the result tables of ``evaluate``.

    ``items``: filename, gold_label, content (and ``item_no``, else items are
    numbered by name). Items whose content is NULL could not be read: they are
    counted in the run's metadata and not asked. Answers lie in
    ``<base>/answers/<run id>``, results in ``<base>/results/<run id>``."""
    spark = items.sparkSession
    run_id = run_id or spark.range(1).select(new_run_id()).first()[0]
    readable = items.where(F.col("content").isNotNull())
    if "item_no" not in items.columns:
        readable = dense_index(readable, ["filename", "gold_label"], "item_no")
    requests = build_requests(readable, models, instruction, keep=("filename", "gold_label", "item_no"),
                              providers=providers)
    answers = run_pending(requests, detector, f"{base}/answers/{run_id}", waves=waves, carry=REQUEST_COLUMNS)
    commit_run(detection_rows(None, answers), base, run_id, source_dir, origins, items)
    return evaluate(read_run(spark, base, run_id), f"{base}/results/{run_id}", targets, synonyms, origins, scopes)
