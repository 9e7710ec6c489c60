"""Report tables and the numbers behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, mean_error_text, parse_error, parse_mean
from tabwright.functions.ordering import join_keys
from tabwright.operators import metrics as H
from tabwright.plans.options import CLUSTERING_MODELS, METRIC_DEFINITIONS

# Measure -> report suffix.
SUFFIX = {
    "auc": "auc",
    "accuracy": "acc",
    "sensitivity": "sensitivity",
    "specificity": "specificity",
    "npv": "npv",
    "ppv": "ppv",
    "f1": "f1score",
    "kappa": "kappa",
}
PREFIX = {"test": "test", "train": "trt"}
LOWER_IS_BETTER = ("davies_bouldin_score",)


def long_metrics(train_test: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, metric, value) with names like ``test_auc`` from a (by, dataset) metric table."""
    stack = train_test.unpivot(
        [*[c(b) for b in by], F.col("dataset")], [c(m) for m in SUFFIX], "measure", "value"
    )
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
    return stack.select(
        *[c(b) for b in by],
        F.concat_ws("_", prefix[F.col("dataset")], suffix[F.col("measure")]).alias("metric"),
        "value",
    )


def report_columns(best_score: bool = False, features: Sequence[str] = ()) -> list[str]:
    """Report columns in order."""
    out = [f"test_{s}" for s in SUFFIX.values()] + [f"trt_{s}" for s in SUFFIX.values()]
    out += ["best_score"] if best_score else []
    out += ["n_train", "n_test"]
    out += [f"cvt_{s}" for m, s in SUFFIX.items() if m != "kappa"]
    return out + [f"shap_{f}" for f in features]


def results_report(
    long: DataFrame, cv: DataFrame | None, features_key: str, columns: Sequence[str]
) -> DataFrame:
    """One row per model, every cell as text.

    ``long(model, metric, value)``; ``cv(model, metric, value, moe)`` gives the
    ``cvt_*`` columns as ``m ± e``. Values have 3 decimals; NULL shows as N/A.
    Tables of models × metrics: small whatever the data.
    """
    whole = F.col("metric").isin("n_train", "n_test")
    text = long.select(
        "model",
        "metric",
        F.when(whole, F.col("value").cast("long").cast("string"))
        .otherwise(F.round("value", 3).cast("string"))
        .alias("cell"),
    )
    if cv is not None:
        suffix = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
        text = text.unionByName(
            cv.select(
                "model",
                F.concat(F.lit("cvt_"), suffix[F.col("metric")]).alias("metric"),
                mean_error_text(F.col("value"), F.col("moe")).alias("cell"),
            )
        )
    wide = text.groupBy("model").pivot("metric", list(columns)).agg(F.first("cell"))
    return wide.select(
        "model",
        F.lit(features_key).alias("features"),
        *[F.coalesce(c(x), F.lit("N/A")).alias(x) for x in columns],
    )


def parse_mean_error(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``m ± e`` texts to a number and a ``<column>_err`` number; N/A counts as 0 ± 0."""
    new = {}
    for x in columns:
        new[x] = parse_mean(c(x))
        new[f"{x}_err"] = parse_error(c(x))
    return report.withColumns({k: v for k, v in new.items()}) if new else report


def true_false_rates(report: DataFrame, prefix: str = "test") -> DataFrame:
    """(model, tpr, fpr, tnr, fnr) as means over a model's rows."""
    g = report.groupBy("model").agg(
        F.avg(f"{prefix}_sensitivity").alias("tpr"), F.avg(f"{prefix}_specificity").alias("tnr")
    )
    return g.select(
        "model", "tpr", (1 - F.col("tnr")).alias("fpr"), "tnr", (1 - F.col("tpr")).alias("fnr")
    )


def auc_comparison(report: DataFrame) -> DataFrame:
    """(model, test_auc, trt_auc, cvt_auc, cvt_auc_err), clustering models left out."""
    return report.where(~F.col("model").isin(*CLUSTERING_MODELS)).groupBy("model").agg(
        *[F.avg(x).alias(x) for x in ("test_auc", "trt_auc", "cvt_auc", "cvt_auc_err")]
    )


def metric_heatmap(
    report: DataFrame,
    metrics: Sequence[str],
    models: Sequence[str],
    supervised: bool = True,
) -> DataFrame:
    """Metric × model matrix.

    Supervised: plain values, and AUC rows leave when no model has one.
    Clustering: each metric min-max scaled over the models, turned round where
    lower is better; a constant metric is 0 before turning.
    """
    long = report.unpivot([F.col("model")], [c(m) for m in metrics], "metric", "value")
    w = Window.partitionBy("metric")
    if supervised:
        # a table of metrics × models: one small window tells whether any model has an area
        area = F.max(F.when(F.col("metric") == "test_auc", F.col("value"))).over(Window.partitionBy())
        long = long.withColumn("__t", area)
        long = long.where(~F.col("metric").endswith("_auc") | F.col("__t").isNotNull()).drop("__t")
    else:
        lo, hi = F.min("value").over(w), F.max("value").over(w)
        scaled = F.when(hi != lo, (F.col("value") - lo) / (hi - lo)).otherwise(
            F.when(F.col("value").isNotNull(), 0.0)
        )
        long = long.withColumn(
            "value", F.when(F.col("metric").isin(*LOWER_IS_BETTER), 1 - scaled).otherwise(scaled)
        )
    return long.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def best_per_metric(report: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, model, value) of every winner, ties included."""
    long = report.unpivot([F.col("model")], [c(m) for m in metrics], "metric", "value").where(
        F.col("value").isNotNull()
    )
    goodness = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    best = long.withColumn("__g", goodness).withColumn(
        "__b", F.max("__g").over(Window.partitionBy("metric"))
    )
    return best.where(F.col("__g") == F.col("__b")).select("metric", "model", "value")


def roc_overlay(pred: DataFrame) -> DataFrame:
    """ROC points of all supervised models with their area, areas ascending."""
    sup = pred.where(~F.col("model").isin(*CLUSTERING_MODELS))
    return (
        join_keys(H.roc_curve(sup), H.roc_auc(sup), ["model"])
        .select("model", "auc", "fpr", "tpr", "threshold")
        .orderBy("auc", "model", F.desc_nulls_first("threshold"))
    )


def best_score_ranking(report: DataFrame) -> DataFrame:
    """(model, mean): mean best tuning score, descending."""
    return report.groupBy("model").agg(F.avg("best_score").alias("mean")).orderBy(F.desc("mean"), "model")


def label_table(labels: DataFrame, row_id: str, models: Sequence[str]) -> DataFrame:
    """Row id and one ``<model> labels`` column per clustering model."""
    wide = labels.groupBy(c(row_id)).pivot("model", list(models)).agg(F.first("label"))
    return wide.select(c(row_id), *[c(m).alias(f"{m} labels") for m in models])


def metric_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRIC_DEFINITIONS.items()), "metric string, description string")


def describe_metrics(long: DataFrame) -> DataFrame:
    """Long metrics with the meaning of each."""
    return long.join(metric_definitions(long.sparkSession), "metric", "left")


def cluster_scatter(coords: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Two-component coordinates with cluster label and noise flag."""
    return coords.join(labels, row_id).withColumn("is_noise", F.col("label") == -1)
