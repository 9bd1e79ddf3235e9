"""Sinks (S6-S11): datasets, result tables, run summaries, the run log, models and
best-parameter records.  All are plain DataFrame writes; paths should live in a
shared folder (on a cluster, under ``spark.checkpoint.dir``'s filesystem)."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LOG_SCHEMA = "run_id string, key string, kind string, value string, logged_at timestamp"


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a dataset (S6).  ``partition_by`` (e.g. a source column) enables partition pruning."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_results(results: DataFrame, path: str, drop: Sequence[str] = ("predictions",)) -> None:
    """Write a result table without bulky per-row columns."""
    write_dataset(results.drop(*[c for c in drop if c in results.columns]), path)


def run_summary(comparison: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Success / failure counts and rate of a batch run, plus duration statistics."""
    s = comparison.agg(F.count(F.lit(1)).alias("n_models"),
                       F.count_if(F.col("state") == "COMPLETE").alias("n_succeeded"),
                       F.count_if(F.col("state") != "COMPLETE").alias("n_failed"))
    s = s.withColumn("success_rate", F.coalesce(F.try_divide(F.col("n_succeeded").cast("double"),
                                                             F.col("n_models")), F.lit(0.0)))
    if durations is not None:
        d = durations.agg(F.sum("seconds").alias("total_seconds"), F.avg("seconds").alias("mean_seconds"))
        s = s.crossJoin(d)
    return s


def append_runs(df: DataFrame, path: str, key: str = "run_id") -> None:
    """Append the runs in ``df`` to a table with one folder per run, each exactly once.

    The rows are staged by the job and replace the folders of their own runs when it commits; other runs are not touched.  So a
    retried or repeated append of a run adds no rows, and readers see a run whole or not at all.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``append_runs`` keeps; the schema is given, as run ids that look like numbers stay strings."""
    return spark.read.schema(schema).parquet(path)


def run_rows(runs: DataFrame, run: str, metrics: Sequence[str], params: Sequence[str] = ()) -> DataFrame:
    """Run-log rows (run_id, key, kind, value) of a table with one row per run."""
    cells = [(c, kind) for cols, kind in ((metrics, "metric"), (params, "param")) for c in cols]
    rows = F.array(*[F.struct(F.lit(c).alias("key"), F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for c, kind in cells])
    return runs.select(F.col(run).cast("string").alias("run_id"), F.inline(rows))


def log_run(spark: SparkSession, path: str, metrics: Mapping[str, float], params: Mapping[str, object],
            run_id: str | None = None) -> str:
    """Append one run's metrics and parameters as rows (run_id, key, kind, value) (S9); logging a run again replaces it."""
    run_id = run_id or uuid.uuid4().hex
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, k, "metric", repr(float(v)), now) for k, v in metrics.items()]
    rows += [(run_id, k, "param", str(v), now) for k, v in params.items()]
    append_runs(spark.createDataFrame(rows, RUN_LOG_SCHEMA), path)
    return run_id


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


BEST_SCHEMA = ("run_id string, model string, params map<string,string>, best_score double, best_trial int, "
               "recorded_at timestamp, test_metrics map<string,double>")


def record_best(spark: SparkSession, path: str, model: str, params: Mapping[str, object], score: float,
                trial: int, test_metrics: Mapping[str, float], run_id: str | None = None) -> None:
    """Append the best full parameter map of a model with its score and test metrics (S11); recording a run again replaces it."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (run_id or uuid.uuid4().hex, model, {k: str(v) for k, v in params.items()}, float(score), int(trial), now,
           {k: float(v) for k, v in test_metrics.items()})
    append_runs(spark.createDataFrame([row], BEST_SCHEMA), path)


def read_best(spark: SparkSession, path: str, model: str) -> dict[str, str] | None:
    """Latest recorded parameter map of ``model`` (to configure a refit)."""
    rows = (read_runs(spark, path, BEST_SCHEMA).where(F.col("model") == model)
            .orderBy(F.col("recorded_at").desc()).limit(1).collect())
    return dict(rows[0]["params"]) if rows else None
