"""Classification measures as grouped aggregations over a predictions table.

Input: ``(by..., row_id, label, prediction, score | probability array)``; label
and prediction are class codes. Everything after the first count works on
(group, class, class) cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, safe_ratio
from tabwright.functions.ordering import join_keys, running_before

BY = ("model",)
RATES = ("accuracy", "kappa", "sensitivity", "specificity", "ppv", "npv", "f1")


def _cols(by: Sequence[str]) -> list[Column]:
    return [c(b) for b in by]


def confusion_cells(pred: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Non-zero counts per (by, label, prediction)."""
    return pred.groupBy(*_cols(by), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Counts per (label, prediction) with zero cells for every class the group shows."""
    cells = confusion_cells(pred, by)
    classes = cells.groupBy(*_cols(by)).agg(
        F.array_union(F.collect_set("label"), F.collect_set("prediction")).alias("k")
    )
    grid = classes.withColumn("label", F.explode("k")).withColumn("prediction", F.explode("k")).drop("k")
    return join_keys(grid, cells, [*by, "label", "prediction"]).withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )


def class_cells(cells: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, class, tp, fn, fp, tn) one-vs-rest counts from confusion cells."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    parts = cells.select(
        *_cols(by),
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), hit.cast("long").alias("tp")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("p"),
    ).select(*_cols(by), "p.*")
    per = parts.groupBy(*_cols(by), "class").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("tp").alias("tp")
    )
    total = F.sum("a").over(Window.partitionBy(*_cols(by)))
    return per.select(
        *_cols(by),
        "class",
        "tp",
        (F.col("a") - F.col("tp")).alias("fn"),
        (F.col("b") - F.col("tp")).alias("fp"),
        (total - F.col("a") - F.col("b") + F.col("tp")).alias("tn"),
    )


def per_class_rates(cells: DataFrame) -> DataFrame:
    """recall, specificity, precision, npv, f1 per class row.

    Undefined recall, precision and f1 are 0; undefined specificity and npv NULL.
    """
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    zero = F.lit(0.0)
    return cells.withColumns(
        {
            "recall": safe_ratio(tp, tp + fn, zero),
            "specificity": safe_ratio(tn, tn + fp),
            "precision": safe_ratio(tp, tp + fp, zero),
            "npv": safe_ratio(tn, tn + fn),
            "f1": safe_ratio(2 * tp, 2 * tp + fp + fn, zero),
        }
    )


def classification_metrics(
    pred: DataFrame, by: Sequence[str] = BY, macro: bool = False
) -> DataFrame:
    """n, accuracy, kappa, sensitivity, specificity, ppv, npv, f1 per group.

    At most two distinct labels: measures of class 1. More, or ``macro``: macro
    averages, with classes of undefined specificity or npv skipped.
    """
    return metrics_of_cells(confusion_cells(pred, by), by, macro)


def metrics_of_cells(
    cells: DataFrame, by: Sequence[str] = BY, macro: bool = False
) -> DataFrame:
    """``classification_metrics`` from confusion cells."""
    r = per_class_rates(class_cells(cells, by))
    binary = F.lit(not macro) & (F.count_if(F.col("tp") + F.col("fn") > 0) <= 2)
    positive = F.col("class") == 1
    n = F.max(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).cast("double")
    po = F.sum("tp") / n
    pe = F.sum((F.col("tp") + F.col("fn")).cast("double") * (F.col("tp") + F.col("fp"))) / (n * n)

    def pick(name: str) -> Column:
        one = F.coalesce(F.max(F.when(positive, F.col(name))), F.lit(0.0))
        return F.when(binary, one).otherwise(F.coalesce(F.avg(name), F.lit(0.0)))

    return r.groupBy(*_cols(by)).agg(
        n.cast("long").alias("n"),
        po.alias("accuracy"),
        F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"),
        pick("recall").alias("sensitivity"),
        pick("specificity").alias("specificity"),
        pick("precision").alias("ppv"),
        pick("npv").alias("npv"),
        pick("f1").alias("f1"),
    )


def accuracy(pred: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return pred.groupBy(*_cols(by)).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")
    )


def _score_steps(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives at each distinct score, with totals strictly above it."""
    steps = pred.groupBy(*_cols(by), "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return steps


def roc_curve(pred: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, threshold, fpr, tpr) at every distinct score, plus the (0,0) start (NULL threshold)."""
    steps = _score_steps(pred, by)
    both = running_before(steps, {"neg": "neg_before", "pos": "pos_before"}, "score", by)
    totals = steps.groupBy(*_cols(by)).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    points = join_keys(both, totals, by).select(
        *_cols(by),
        F.col("score").alias("threshold"),
        safe_ratio(F.col("neg_before") + F.col("neg"), F.col("q")).alias("fpr"),
        safe_ratio(F.col("pos_before") + F.col("pos"), F.col("p")).alias("tpr"),
    )
    start = totals.select(
        *_cols(by),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def area_of_steps(steps: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, auc) from positives and negatives per distinct score."""
    placed = running_before(steps, {"pos": "pos_before"}, "score", by)
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    return placed.groupBy(*_cols(by)).agg(
        safe_ratio(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def roc_auc(pred: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when one class is absent."""
    return area_of_steps(_score_steps(pred, by), by)


def roc_auc_ovr(pred: DataFrame, by: Sequence[str] = BY, prob: str = "prob") -> DataFrame:
    """Unweighted mean of one-vs-rest areas; NULL when any class has no rows."""
    long = pred.select(
        *_cols(by), F.col("label").alias("__y"), F.posexplode(c(prob)).alias("class", "score")
    ).select(*_cols(by), "class", "score", (F.col("__y") == F.col("class")).cast("int").alias("label"))
    per = roc_auc(long, [*by, "class"])
    return per.groupBy(*_cols(by)).agg(
        F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc")
    )


def auc_any(pred: DataFrame, by: Sequence[str] = BY, prob: str = "prob") -> DataFrame:
    """Binary area of the class-1 score for two-class vectors, one-vs-rest mean otherwise."""
    long = pred.select(
        *_cols(by),
        F.col("label").alias("__y"),
        F.when(F.size(prob) == 2, F.array(F.struct(F.lit(1).alias("k"), F.col(prob)[1].alias("s"))))
        .otherwise(F.transform(F.col(prob), lambda s, i: F.struct(i.alias("k"), s.alias("s"))))
        .alias("__ks"),
    ).select(*_cols(by), "__y", F.inline("__ks"))
    long = long.select(
        *_cols(by),
        F.col("k").alias("class"),
        F.col("s").alias("score"),
        (F.col("__y") == F.col("k")).cast("int").alias("label"),
    )
    per = roc_auc(long, [*by, "class"])
    return per.groupBy(*_cols(by)).agg(
        F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc")
    )


def mean_and_error(col: Column) -> tuple[Column, Column]:
    """Mean and 1.96·std_pop/√n over folds (0 for a single fold)."""
    n = F.count(col)
    return F.avg(col), F.when(n > 1, 1.96 * F.stddev_pop(col) / F.sqrt(n.cast("double"))).otherwise(
        F.when(n == 1, F.lit(0.0))
    )


CV_METRICS = ("auc", "accuracy", "sensitivity", "specificity", "ppv", "npv", "f1")


def all_metrics(pred: DataFrame, by: Sequence[str], prob: str | None = None) -> DataFrame:
    """Every measure per group.

    With a score column both halves read one table of counts per (group, score,
    label, prediction), so the predictions are scanned and shuffled once.
    """
    if prob is not None:
        return join_keys(classification_metrics(pred, by), auc_any(pred, by, prob), by)
    counts = pred.groupBy(*_cols(by), "score", "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(*_cols(by), "label", "prediction").agg(F.sum("n").alias("n"))
    is_pos = F.col("label") == 1
    steps = counts.groupBy(*_cols(by), "score").agg(
        F.sum(F.when(is_pos, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(is_pos, 0).otherwise(F.col("n"))).alias("neg"),
    )
    return join_keys(metrics_of_cells(cells, by), area_of_steps(steps, by), by)


def fold_metrics(pred: DataFrame, by: Sequence[str] = BY, prob: str | None = None) -> DataFrame:
    """All measures per (by, repeat, fold)."""
    return all_metrics(pred, [*by, "repeat", "fold"], prob)


def cross_validation_summary(folds: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Long (by, metric, value, moe) from a fold-metric table."""
    long = folds.unpivot(_cols(by), [c(m) for m in CV_METRICS], "metric", "v")
    mean, moe = mean_and_error(F.col("v"))
    return long.groupBy(*_cols(by), "metric").agg(mean.alias("value"), moe.alias("moe"))


def cross_validate_predictions(
    pred: DataFrame, by: Sequence[str] = BY, prob: str | None = None
) -> DataFrame:
    """Mean and margin of error per metric over the folds of a predictions table."""
    return cross_validation_summary(fold_metrics(pred, by, prob), by)


def train_test_metrics(
    pred: DataFrame, by: Sequence[str] = BY, prob: str | None = None
) -> DataFrame:
    """All measures per (by, dataset) in one grouped pass, with row counts."""
    return all_metrics(pred, [*by, "dataset"], prob)


class SpecificityEvaluator(Evaluator):
    """Specificity as a pluggable score for cross-validation."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.label_col, self.prediction_col = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        pred = dataset.select(
            F.lit(1).alias("model"),
            c(self.label_col).cast("int").alias("label"),
            c(self.prediction_col).cast("int").alias("prediction"),
        )
        row = classification_metrics(pred).select("specificity").first()
        return float(row[0]) if row and row[0] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Rows per (label, cluster)."""
    return df.groupBy(*_cols(by), c(label).alias("label"), c(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n")
    )


def model_kind_counts(runs: DataFrame, by: Sequence[str], model: str = "model") -> DataFrame:
    """Clustering and supervised models per run."""
    from tabwright.plans.options import CLUSTERING_MODELS

    is_cluster = c(model).isin(*CLUSTERING_MODELS)
    return runs.groupBy(*_cols(by)).agg(
        F.count_if(is_cluster).alias("n_clustering"), F.count_if(~is_cluster).alias("n_supervised")
    )


__all__ = [x for x in dir() if not x.startswith("_")]
