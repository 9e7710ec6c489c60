"""Training options: model names, defaults and search ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

# Model names as they appear in reports and option rows.
SUPERVISED_MODELS = (
    "randomforest",
    "neuralnetwork",
    "xgboost",
    "gradientboosting",
    "histgradientboosting",
    "bagging",
    "sgdclassifier",
    "logisticregression",
    "kneighbors",
)
CLUSTERING_MODELS = ("spectralclustering", "kmeans", "hdbscan")

# Search ranges as (start, stop, step) and searched value lists.
RANGES: dict[str, tuple[float, float, float]] = {
    "n_estimators": (10, 200, 10),
    "c": (0.1, 100, 0.1),
    "max_depth": (5, 30, 5),
    "subsample": (0.1, 1.0, 0.1),
    "validation_fraction": (0.01, 0.5, 0.01),
    "n_iter_no_change": (5, 50, 5),
    "learning_rate": (0.01, 1.0, 0.01),
    "nn_hidden_layer_sizes": (10, 1000, 10),
    "nn_hidden_layer_depth": (1, 2, 1),
    "nn_learning_rate": (0.0001, 0.01, 0.001),
    "alpha": (0.000001, 0.001, 0.00001),
    "n_neighbors": (3, 50, 1),
    "num_clusters": (2, 5, 1),
    "min_cluster_size": (5, 100, 5),
    "min_samples": (5, 200, 2),
    "cluster_selection_epsilon": (0.0, 1.0, 0.1),
    "nearest_neighbors": (5, 50, 5),
    "max_iter": (100, 500, 50),
    "n_init": (5, 20, 5),
}
LISTS: dict[str, tuple[Any, ...]] = {
    "max_features": ("sqrt", "log2"),
    "min_samples_leaf": (1, 2, 4),
    "bootstrap": (True, False),
    "affinity": ("rbf", "nearest_neighbors"),
}
SUPERVISED_GOALS = ("f1_macro", "precision_macro", "accuracy", "recall_macro")
CLUSTERING_GOALS = ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score")

# What each report column means.
METRIC_DEFINITIONS = {
    "test_auc": "Area Under the ROC Curve (test set). Measures discrimination: 0.5=chance, 1.0=perfect.",
    "test_acc": "Accuracy (test set). Proportion of correct predictions.",
    "test_sensitivity": "Sensitivity / Recall (test set). True positive rate: TP/(TP+FN).",
    "test_specificity": "Specificity (test set). True negative rate: TN/(TN+FP).",
    "test_npv": "Negative Predictive Value (test set). TN/(TN+FN).",
    "test_ppv": "Positive Predictive Value / Precision (test set). TP/(TP+FP).",
    "test_f1score": "F1 Score (test set). Harmonic mean of precision and recall.",
    "test_kappa": "Cohen's Kappa (test set). Agreement corrected for chance.",
    "trt_auc": "Area Under the ROC Curve (training set). Check for overfitting vs test AUC.",
    "trt_acc": "Accuracy (training set).",
    "trt_sensitivity": "Sensitivity (training set).",
    "trt_specificity": "Specificity (training set).",
    "trt_f1score": "F1 Score (training set).",
    "cvt_auc": "Cross-validated AUC (mean ± margin of error).",
    "cvt_acc": "Cross-validated accuracy (mean ± margin of error).",
    "cvt_sensitivity": "Cross-validated sensitivity (mean ± margin of error).",
    "cvt_specificity": "Cross-validated specificity (mean ± margin of error).",
    "cvt_f1score": "Cross-validated F1 score (mean ± margin of error).",
    "best_score": "Best tuning score for this model.",
    "silhouette_score": "Clustering: how similar an object is to its own cluster vs others. Range [-1, 1], higher is better.",
    "calinski_harabasz_score": "Clustering: ratio of between-cluster to within-cluster dispersion. Higher is better.",
    "davies_bouldin_score": "Clustering: average similarity ratio of each cluster. Lower is better (minimum 0).",
}


@dataclass(frozen=True)
class TrainingOptions:
    """Everything one training run can be told, with its defaults."""

    class_column: str | None = None
    supervised: bool = True
    train_group: tuple[str, ...] = SUPERVISED_MODELS
    test_size: float = 0.2
    random_state: int = 42
    standard_scaler: bool = False
    train_sample_type: int = 0  # 0 none, 1 undersample, 2 oversample
    parameter_tune: bool = True
    n_iter: int = 100
    folds: int = 5
    repeats: int = 1
    parameter_goal: str = "f1_macro"
    clustering_parameter_goal: str = "silhouette_score"
    shap_feature_explainability: bool = True
    shap_sample_size: int = 10  # background rows
    shap_permutations: int = 4
    shap_diagram_features: int = 10
    num_clusters: int = 2
    synthesize_original: bool = False
    synthesize_new: bool = False
    model_params: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, values: dict[str, Any]) -> TrainingOptions:
        """From already typed option values; unknown names are dropped."""
        known = {f.name for f in fields(cls)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}
        for goal in ("parameter_goal", "clustering_parameter_goal"):
            if isinstance(kept.get(goal), tuple):
                kept[goal] = kept[goal][0]
        return cls(**kept)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
