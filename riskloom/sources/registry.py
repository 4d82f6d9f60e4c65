"""Trained models and the table of runs.

A run becomes the latest by a published version (see ``sources.versioned``), after its model and its row have been written.
Of two writers that finish together one publishes first and the other after it: there is one latest run at any time.
"""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.bronze import read_or_none
from riskloom.sources.versioned import Conflict, latest_version, publish, read_version

_RUN = "run_id string, model_version string, strategy string, trained_at string, artifact string, metadata string"
#: How often a writer tries to be next, and how long it waits in between.
TRIES, WAIT_SECONDS = 20, 0.5


def save_run(spark: SparkSession, root: str, model: PipelineModel, metadata: dict) -> str:
    """Save the model and the run's row, then make the run the latest unless a newer one is; return the run id.

    Runs are newer by the time of training, then by id. Saving a run id again replaces its model.
    """
    name = metadata["run_id"]
    artifact = f"{root}/models/{name}"
    model.write().overwrite().save(artifact)
    text = json.dumps(metadata, sort_keys=True, default=str)
    row = (name, metadata["model_version"], metadata["strategy"], metadata["trained_at"], artifact, text)
    spark.createDataFrame([row], _RUN).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    facts = {"trained_at": metadata["trained_at"], "run_id": name, "artifact": artifact, "metadata": text}
    for _ in range(TRIES):
        base = latest_version(spark, root)
        held = read_version(spark, root, base) if base else None
        if held and (held["trained_at"], held["run_id"]) > (facts["trained_at"], name):
            return name
        try:
            publish(spark, root, base, facts)
            return name
        except Conflict:
            time.sleep(WAIT_SECONDS)
    raise Conflict(f"run {name} is saved under {root}, but other writers kept it from becoming the latest")


def runs(spark: SparkSession, root: str) -> DataFrame | None:
    """All runs, one row for each id, or ``None`` before the first."""
    table = read_or_none(spark, f"{root}/runs")
    if table is None:
        return None
    newest = F.max_by(F.struct("model_version", "strategy", "trained_at", "artifact", "metadata"), "trained_at")
    return table.groupBy("run_id").agg(newest.alias("_r")).select("run_id", "_r.*")


def latest_run(spark: SparkSession, root: str) -> dict | None:
    """Metadata of the newest published run with its artifact path, or ``None``."""
    newest = read_version(spark, root)
    return {**json.loads(newest["metadata"]), "artifact": newest["artifact"]} if newest else None


def load_latest(spark: SparkSession, root: str) -> tuple[PipelineModel, dict]:
    """Newest model and its metadata."""
    run = latest_run(spark, root)
    if run is None:
        raise FileNotFoundError(f"no trained run under {root}")
    return PipelineModel.load(run["artifact"]), run
