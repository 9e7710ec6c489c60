"""Stored training runs: everything a run leaves behind, kept by report and run, read back or tested again.

Below a root folder each part of a run is a table partitioned by report and run,
written through ``append_run``; fitted models lie beside them. A row in ``runs``
is written last, so a run that was cut short is never taken for a whole one and
can be stored again under its own id.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.operators.models import FittedModel
from tabwright.operators.report import label_table
from tabwright.operators.scoring import retest
from tabwright.plans.options import TrainingOptions
from tabwright.plans.workflow import TrainingRun
from tabwright.sources.tables import append_run, path_exists

ID = re.compile(r"[A-Za-z0-9_.-]+")
#: parts of a run that are tables of their own
TABLES = ("report", "long", "cv", "predictions", "shap", "odds", "codes", "dictionary", "labels")
RUNS = "report string, run string, supervised boolean, class_column string, models array<string>, tables array<string>, options string, params string, failed string"


@dataclass
class StoredRun:
    """A run read back: its tables by name, its models' folders, options and parameters."""

    report_id: str
    run_id: str
    options: TrainingOptions
    tables: dict[str, DataFrame] = field(default_factory=dict)
    model_paths: dict[str, str] = field(default_factory=dict)
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)


def _checked(*ids: str) -> None:
    for x in ids:
        if not ID.fullmatch(x):
            raise ValueError(f"{x!r} cannot name a report or run: letters, digits, _ . and - only")


def _folder(root: str, part: str, report_id: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{part}/report_id={report_id}/run_id={run_id}"


def _empty_like(root: str, part: str, report_id: str, run_id: str, spark: SparkSession) -> None:
    """Removes what an earlier, unfinished attempt at the same run wrote of one part."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(root, part, report_id, run_id))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved_runs(spark: SparkSession, root: str, report_id: str | None = None) -> DataFrame:
    """One row per whole run: (report, run, supervised, class_column, models, tables, options, params, failed).

    A root without any run gives no rows.
    """
    path = f"{root.rstrip('/')}/runs"
    if not path_exists(spark, path):
        return spark.createDataFrame([], RUNS)
    found = spark.read.schema(RUNS).parquet(path)
    return found if report_id is None else found.where(F.col("report") == report_id)


def save_run(run: TrainingRun, options: TrainingOptions, root: str, report_id: str, run_id: str) -> None:
    """Stores a run; earlier runs of the report stay, a run id already stored is an error.

    Predictions and attributions are written by their tasks and never pass the
    driver; the per-model attribution tables become one with a ``model`` column.
    """
    _checked(report_id, run_id)
    spark = run.report.sparkSession
    if not saved_runs(spark, root, report_id).where(F.col("run") == run_id).isEmpty():
        raise ValueError(f"run {run_id} of {report_id} is stored already")
    parts = {x: getattr(run, x) for x in TABLES if x != "shap" and getattr(run, x) is not None}
    shap = None
    for name, rows in run.shap.items():
        rows = rows.withColumn("model", F.lit(name))
        shap = rows if shap is None else shap.unionByName(rows, allowMissingColumns=True)
    if shap is not None:
        parts["shap"] = shap
    for name, df in parts.items():
        _empty_like(root, name, report_id, run_id, spark)
        append_run(df.withColumns({"report_id": F.lit(report_id), "run_id": F.lit(run_id)}), f"{root.rstrip('/')}/{name}")
    for name, model in run.models.items():
        model.save(f"{_folder(root, 'models', report_id, run_id)}/{name}", spark)
    row = (
        report_id, run_id, options.supervised, options.class_column, sorted(run.models), sorted(parts),
        json.dumps(options.to_dict()), json.dumps(run.params, default=str), json.dumps(run.failed, default=str),
    )
    done = spark.createDataFrame([row], RUNS).coalesce(1)
    append_run(done.withColumns({"report_id": F.lit(report_id), "run_id": F.lit(run_id)}), f"{root.rstrip('/')}/runs")


def load_run(spark: SparkSession, root: str, report_id: str, run_id: str | None = None) -> StoredRun:
    """A stored run, the newest (largest run id) unless one is named; reads only that run's folders."""
    found = saved_runs(spark, root, report_id)
    found = found if run_id is None else found.where(F.col("run") == run_id)
    row = found.orderBy(F.col("run").desc()).first()
    if row is None:
        raise ValueError(f"no stored run {run_id or ''} of {report_id}".replace("  ", " "))
    run = row["run"]
    options = TrainingOptions.from_rows(json.loads(row["options"]))
    tables = {}
    for name in row["tables"]:
        path = _folder(root, name, report_id, run)
        # a part without rows leaves no files
        if path_exists(spark, path):
            tables[name] = spark.read.parquet(path)
    models = {x: f"{_folder(root, 'models', report_id, run)}/{x}" for x in row["models"]}
    return StoredRun(report_id, run, options, tables, models, json.loads(row["params"]), json.loads(row["failed"]))


def retest_run(spark: SparkSession, stored: StoredRun, testset: DataFrame | None, row_id: str = "row_id", **kw: Any) -> DataFrame:
    """``retest`` with a stored run's models, class column and label codes; labels may be text."""
    if stored.options.class_column is None or not stored.model_paths:
        raise ValueError("only a supervised run can be tested again")
    return retest(spark, stored.model_paths, testset, stored.options.class_column, row_id, stored.tables.get("codes"), **kw)


def stored_label_table(stored: StoredRun) -> DataFrame:
    """Row labels of a stored clustering run, a column per model."""
    labels = stored.tables.get("labels")
    if labels is None:
        raise ValueError("only a clustering run has row labels")
    row_id = next(x for x in labels.columns if x not in ("label", "model"))
    return label_table(labels, row_id, sorted(stored.params))


def compare_runs(spark: SparkSession, root: str, report_id: str, metric: str = "test_auc") -> DataFrame:
    """(run_id, model, value, change): a measure over a report's whole runs, against the run before."""
    whole = saved_runs(spark, root, report_id).select(F.col("run").alias("run_id"))
    path = f"{root.rstrip('/')}/long"
    if not path_exists(spark, path):
        return spark.createDataFrame([], "run_id string, model string, value double, change double")
    schema = "model string, metric string, value double, report_id string, run_id string"
    long = spark.read.schema(schema).parquet(path).where((F.col("report_id") == report_id) & (F.col("metric") == metric))
    before = F.lag("value").over(Window.partitionBy("model").orderBy("run_id"))
    return long.join(whole, "run_id", "left_semi").select("run_id", "model", "value", (F.col("value") - before).alias("change"))


__all__ = [x for x in dir() if not x.startswith("_") and x != "annotations"]
