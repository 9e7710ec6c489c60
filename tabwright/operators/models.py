"""Supervised models: one fit / predict / save / load surface over Spark ML and exact k-NN.

A fitted model keeps the scaler, the column order and the class count, so new
rows are conformed by column name. Predictions come as
``(row_id, [kept columns], prediction, prob)`` with one probability per class.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.functions.ordering import ranked_by_hash
from tabwright.operators.boosting import Booster, BoostOptions, fit_booster
from tabwright.operators.neighbours import nearest
from tabwright.operators.network import Network, NetworkOptions, fit_network
from tabwright.operators.sampling import oversample, undersample
from tabwright.operators.scale import Scaler, fit_scaler
from tabwright.operators.trees import Forest
from tabwright.plans.options import SUPERVISED_MODELS

MAX_TREE_DEPTH = 30  # Spark's limit; deeper requests are an error
HISTOGRAM_BOOSTERS = ("xgboost", "histgradientboosting")
#: rows above which the histogram booster with leaf limit holds rows back and may end early, as its model rule says
EARLY_STOP_ROWS = 10_000
LINEAR = ("logisticregression", "sgdclassifier")


def tree_depth(wanted: Any) -> int:
    if int(wanted) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {wanted} is above {MAX_TREE_DEPTH}, the deepest tree Spark grows")
    return int(wanted)


def make_estimator(name: str, params: dict[str, Any], n: int, d: int, k: int, seed: int = 42):
    """Spark ML estimator of a model name, with its default settings where ``params`` is silent.

    No counterpart exists for a minimum split size. The network here is the l-bfgs
    one, which reads no learning rate or penalty; see ``by_batches``.
    """
    p = dict(params)
    depth = lambda default: tree_depth(p.get("max_depth", default))
    if name in ("randomforest", "bagging"):
        bag = name == "bagging"
        return RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 10 if bag else 100)),
            maxDepth=depth(MAX_TREE_DEPTH),
            featureSubsetStrategy="all" if bag else str(p.get("max_features", "sqrt")),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            bootstrap=bool(p.get("bootstrap", True)),
            subsamplingRate=float(p.get("max_samples", 1.0)),
            # a row keeps its node in each tree, so a level neither sends the trees out nor walks them from the root
            cacheNodeIds=True,
            seed=seed,
        )
    if name == "gradientboosting":
        gbt = GBTClassifier(
            maxIter=int(p.get("n_estimators", 100)),
            maxDepth=depth(3),
            stepSize=float(p.get("learning_rate", 0.1)),
            subsamplingRate=float(p.get("subsample", 1.0)),
            seed=seed,
        )
        if p.get("validation_fraction"):
            gbt = gbt.setValidationIndicatorCol("is_validation")
        return gbt if k <= 2 else OneVsRest(classifier=gbt)
    if name == "sgdclassifier":
        return LogisticRegression(
            regParam=float(p.get("alpha", 1e-4)), elasticNetParam=0.0, standardization=False, maxIter=1000
        )
    if name == "logisticregression":
        return LogisticRegression(
            regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=1000,
        )
    if name == "neuralnetwork":
        hidden = p.get("hidden_layer_sizes", (100,))
        return MultilayerPerceptronClassifier(
            layers=[d, *[int(h) for h in hidden], max(k, 2)],
            maxIter=int(p.get("max_iter", 500)),
            seed=seed,
        )
    raise ValueError(f"Unknown model: {name}")


#: settings that only the mini-batch network reads
BATCH_SETTINGS = {"learning_rate_init", "alpha", "batch_size", "early_stopping", "validation_fraction", "n_iter_no_change", "tol"}


def by_batches(params: dict[str, Any]) -> bool:
    """Whether a network is trained by mini-batches: ``solver="adam"``, or no solver but a setting only that one reads."""
    solver = params.get("solver", "adam" if BATCH_SETTINGS & params.keys() else "lbfgs")
    if solver not in ("adam", "lbfgs"):
        raise ValueError(f"unknown solver {solver!r}: adam or lbfgs")
    return solver == "adam"


def network_options(params: dict[str, Any], seed: int = 42) -> NetworkOptions:
    """Settings of the mini-batch network by their usual names."""
    p = dict(params)
    return NetworkOptions(
        hidden=tuple(int(h) for h in p.get("hidden_layer_sizes", (100,))),
        rate=float(p.get("learning_rate_init", 1e-3)),
        l2=float(p.get("alpha", 1e-4)),
        batch=int(p.get("batch_size", 200)),
        max_epochs=int(p.get("max_iter", 500)),
        tolerance=float(p.get("tol", 1e-4)),
        patience=int(p.get("n_iter_no_change", 10)),
        early_stopping=bool(p.get("early_stopping", False)),
        held_back=float(p.get("validation_fraction", 0.1)),
        seed=seed,
    )


def boost_options(name: str, params: dict[str, Any], n: int, seed: int = 42) -> BoostOptions:
    """Settings of a histogram booster by model name."""
    p = dict(params)
    if name == "xgboost":
        return BoostOptions(
            rounds=int(p.get("n_estimators", 100)),
            rate=float(p.get("learning_rate", 0.3)),
            max_depth=int(p.get("max_depth", 6)),
            subsample=float(p.get("subsample", 1.0)),
            l2=float(p.get("reg_lambda", 1.0)),
            least_gain=float(p.get("gamma", 0.0)),
            least_hessian=float(p.get("min_child_weight", 1.0)),
            seed=seed,
        )
    depth = p.get("max_depth")
    return BoostOptions(
        rounds=int(p.get("max_iter", 100)),
        rate=float(p.get("learning_rate", 0.1)),
        max_depth=None if depth is None else int(depth),
        max_leaves=int(p.get("max_leaf_nodes", 31)),
        l2=float(p.get("l2_regularization", 0.0)),
        least_hessian=1e-3,
        least_rows=int(p.get("min_samples_leaf", 20)),
        max_bins=int(p.get("max_bins", 255)),
        softmax_hessian=1.0,
        held_back=float(p.get("validation_fraction", 0.1)) if n > EARLY_STOP_ROWS else 0.0,
        patience=int(p.get("n_iter_no_change", 10)),
        seed=seed,
    )


@dataclass
class FittedModel:
    """A fitted classifier with everything needed to score raw rows."""

    name: str
    columns: tuple[str, ...]
    n_classes: int
    scaler: Scaler
    stage: Any = None  # Spark ML model or Booster
    points: DataFrame | None = None  # k-NN: (id, v, label)
    k: int = 5
    codes: DataFrame | None = None  # class labels and their codes

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and the scaled feature array ``v`` in training column order."""
        missing = sorted(set(self.columns) - set(df.columns))
        if missing:
            raise ValueError(f"Test set is missing columns: {', '.join(missing)}")
        scaled = self.scaler.transform(df)
        return scaled.select(
            *[c(x) for x in keep], F.array(*[c(x).cast("double") for x in self.columns]).alias("v")
        )

    def score_vectors(self, df: DataFrame, row_id: str) -> DataFrame:
        """Adds ``prediction`` (int) and ``prob`` (array) to rows holding ``v``."""
        if self.points is not None:
            return self._vote(df, row_id)
        if isinstance(self.stage, (Booster, Network)):
            return df.withColumn("prob", _array_scores(self.stage)("v")).withColumn(
                "prediction", (F.array_position("prob", F.array_max("prob")) - 1).cast("int")
            ).select(*[c(x) for x in df.columns], "prediction", "prob")
        have = df.columns
        out = self.stage.transform(df.withColumn("features", array_to_vector(F.col("v"))))
        if isinstance(self.stage, OneVsRestModel):
            # one boosted margin per class: logistic of twice the margin, then shares
            raw = F.transform(
                vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x))
            )
            total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
            prob = F.transform(raw, lambda x: x / total)
        else:
            prob = vector_to_array("probability")
        return out.select(
            *[c(x) for x in have], F.col("prediction").cast("int").alias("prediction"), prob.alias("prob")
        )

    def _vote(self, df: DataFrame, row_id: str) -> DataFrame:
        near = nearest(
            df.select(c(row_id).alias("id"), "v"), self.points, self.k, payload="label", payload_type="int"
        )
        share = [
            (F.count_if(F.col("label") == i) / F.lit(float(self.k))).alias(f"p{i}")
            for i in range(self.n_classes)
        ]
        votes = near.groupBy(F.col("query_id").alias(row_id)).agg(*share)
        prob = F.array(*[F.col(f"p{i}") for i in range(self.n_classes)])
        voted = votes.select(
            row_id,
            (F.array_position(prob, F.array_max(prob)) - 1).cast("int").alias("prediction"),
            prob.alias("prob"),
        )
        return df.join(voted, row_id)

    def predict(self, df: DataFrame, row_id: str, keep: Sequence[str] = ()) -> DataFrame:
        """(row_id, keep..., prediction, prob) for raw rows."""
        cols = [row_id, *[x for x in keep if x != row_id]]
        return self.score_vectors(self.vectors(df, cols), row_id).drop("v")

    # saving -----------------------------------------------------------------
    def save(self, path: str, spark: SparkSession) -> None:
        meta = {
            "name": self.name,
            "columns": list(self.columns),
            "n_classes": self.n_classes,
            "k": self.k,
            "codes": self.codes is not None,
            "stage": type(self.stage).__name__ if self.stage is not None else None,
            "scaler": {
                "kind": self.scaler.kind,
                "shift": list(self.scaler.shift),
                "width": list(self.scaler.width),
            },
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/meta")
        if isinstance(self.stage, Booster):
            _save_booster(self.stage, f"{path}/stage", spark)
        elif isinstance(self.stage, Network):
            _save_network(self.stage, f"{path}/stage", spark)
        elif self.stage is not None:
            self.stage.write().overwrite().save(f"{path}/stage")
        else:
            self.points.write.mode("overwrite").parquet(f"{path}/points")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FittedModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        columns = tuple(meta["columns"])
        s = meta["scaler"]
        stage = points = None
        if meta["stage"] == "Booster":
            stage = _load_booster(f"{path}/stage", spark)
        elif meta["stage"] == "Network":
            stage = _load_network(f"{path}/stage", spark)
        elif meta["stage"]:
            stage = _STAGES[meta["stage"]].load(f"{path}/stage")
        else:
            points = spark.read.parquet(f"{path}/points")
        scaler = Scaler(s["kind"], columns, tuple(s["shift"]), tuple(s["width"]))
        codes = spark.read.parquet(f"{path}/codes") if meta.get("codes") else None
        return cls(meta["name"], columns, meta["n_classes"], scaler, stage, points, meta["k"], codes)


def _array_scores(model: Booster | Network):
    """Column function from feature arrays to class probabilities."""

    @F.pandas_udf("array<double>")
    def prob(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list(model.probabilities(np.vstack(v.to_numpy()).astype(float))))

    return prob


def _save_booster(b: Booster, path: str, spark: SparkSession) -> None:
    """A row per node; the first row has the starting margins and sizes."""
    f = b.forest
    facts = {"base": b.base.tolist(), "rounds": b.rounds, "losses": b.losses, "n_features": f.n_features, "roots": f.roots.tolist()}
    nodes = [
        (i, int(f.feature[i]), float(f.threshold[i]), int(f.left[i]), int(f.right[i]), f.value[i].tolist(), float(f.cover[i])) for i in range(len(f.feature))
    ]
    schema = "node int, feature int, threshold double, left int, right int, value array<double>, cover double"
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def _load_booster(path: str, spark: SparkSession) -> Booster:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    base = np.array(facts["base"], float)
    d = spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
    value = np.vstack(d["value"].to_numpy()) if len(d) else np.zeros((0, len(base)))
    whole = lambda name: d[name].to_numpy(np.int64)
    forest = Forest(
        np.array(facts["roots"], np.int64), whole("feature"), d["threshold"].to_numpy(float), whole("left"), whole("right"),
        value, d["cover"].to_numpy(float), facts["n_features"],
    )
    return Booster(base, forest, facts["rounds"], [tuple(x) for x in facts["losses"]])


def _save_network(net: Network, path: str, spark: SparkSession) -> None:
    """A row per layer: sizes, weights by input and offsets."""
    rows = [(i, *w.shape, w.ravel().tolist(), b.tolist(), net.epochs, net.losses) for i, (w, b) in enumerate(zip(net.weights, net.offsets, strict=True))]
    schema = "layer int, inputs int, outputs int, weights array<double>, offsets array<double>, epochs int, losses array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def _load_network(path: str, spark: SparkSession) -> Network:
    rows = spark.read.parquet(path).orderBy("layer").collect()
    return Network(
        [np.array(r["weights"], float).reshape(r["inputs"], r["outputs"]) for r in rows],
        [np.array(r["offsets"], float) for r in rows], rows[0]["epochs"], list(rows[0]["losses"]),
    )


_STAGES: dict[str, Any] = {
    m.__name__: m
    for m in (
        GBTClassificationModel,
        LogisticRegressionModel,
        MultilayerPerceptronClassificationModel,
        OneVsRestModel,
        RandomForestClassificationModel,
    )
}


def fit_model(
    name: str,
    train: DataFrame,
    columns: Sequence[str],
    label: str,
    row_id: str,
    params: dict[str, Any] | None = None,
    scaler: Scaler | None = None,
    scaler_kind: str = "minmax",
    sample_type: int = 0,
    seed: int = 42,
    n_classes: int | None = None,
    computed: bool = False,
) -> FittedModel:
    """Scale, resample, fit. ``label`` holds class codes 0..k-1; ``computed`` rows come from a table that is kept already."""
    if name not in SUPERVISED_MODELS:
        raise ValueError(f"Unknown model: {name}")
    params = params or {}
    # the training rows are computed once: scaler, class count and fit read the kept ones
    kept = train.select(c(row_id), c(label).cast("int").alias("label"), *[c(x) for x in columns])
    if name != "kneighbors" and not (computed or train.is_cached):
        kept = kept.persist()
    try:
        scaler = scaler or fit_scaler(kept, columns, scaler_kind)
        return _fitted_on(kept, name, columns, row_id, params, scaler, sample_type, seed, n_classes)
    finally:
        kept.unpersist()


def _fitted_on(
    data: DataFrame,
    name: str,
    columns: Sequence[str],
    row_id: str,
    params: dict[str, Any],
    scaler: Scaler,
    sample_type: int,
    seed: int,
    n_classes: int | None,
) -> FittedModel:
    if sample_type == 1:
        data = undersample(data, "label", row_id, seed)
    elif sample_type == 2:
        data = oversample(data, "label", row_id, seed)
        data = data.withColumn(row_id, F.concat_ws("#", c(row_id).cast("string"), "draw")).drop("draw")
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("k")).first()
    k = n_classes or int(facts["k"]) + 1
    out = FittedModel(name, tuple(columns), k, scaler)
    vec = out.vectors(data, [row_id, "label"])
    if name == "kneighbors":
        out.k = int(params.get("n_neighbors", 5))
        out.points = vec.select(c(row_id).alias("id"), "v", "label")
        return out
    if name in HISTOGRAM_BOOSTERS:
        rows = vec.select(F.xxhash64(c(row_id).cast("string")).alias("key"), "label", "v")
        out.stage = fit_booster(rows, len(columns), k, boost_options(name, params, int(facts["n"]), seed))
        return out
    if name == "neuralnetwork" and by_batches(params):
        rows = vec.select(F.xxhash64(c(row_id).cast("string")).alias("key"), "label", "v")
        out.stage = fit_network(rows, len(columns), k, network_options(params, seed))
        return out
    if params.get("validation_fraction") and name == "gradientboosting":
        share = float(params["validation_fraction"])
        vec = ranked_by_hash(vec, seed, [row_id], by=["label"], out="__r")
        # evenly spaced ranks of each class, ⌊share·n⌋ of them
        vec = vec.withColumn(
            "is_validation", F.floor(F.col("__r") * share) > F.floor((F.col("__r") - 1) * share)
        )
    ready = vec.select(
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("v")).alias("features"),
        *(["is_validation"] if "is_validation" in vec.columns else []),
    )
    # a linear fit keeps blocks of its own: a second copy only takes room, unless rows were drawn anew
    ready = ready if name in LINEAR and not sample_type else ready.persist()
    try:
        out.stage = make_estimator(name, params, int(facts["n"]), len(columns), k, seed).fit(ready)
    finally:
        ready.unpersist()
    return out


def save_model(model: FittedModel, path: str, spark: SparkSession) -> None:
    model.save(path, spark)


def load_model(path: str, spark: SparkSession) -> FittedModel:
    return FittedModel.load(path, spark)


def train_group(
    names: Sequence[str],
    fit: Callable[[str], Any],
    progress: Callable[[int, int, str], None] | None = None,
    log: Callable[[str], None] | None = None,
) -> tuple[dict[str, Any], dict[str, str]]:
    """Run ``fit`` per model name; a failing model is recorded and the rest go on."""
    done: dict[str, Any] = {}
    failed: dict[str, str] = {}
    for i, name in enumerate(names):
        try:
            done[name] = fit(name)
        except Exception as e:  # one model must not stop the others
            failed[name] = str(e)
            if log:
                log(f"Error in train/evaluation of {name}: {e}")
        if progress:
            progress(i + 1, len(names), f"{i + 1}/{len(names)} Processed")
    return done, failed
