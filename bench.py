"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tabwright.queries import load
from tabwright.session import local_session

HEADLINE = (
    "b1_infer_column_types",
    "c2_spec_order",
    "c10_one_hot",
    "d1_stratified_split",
    "d3_oversample",
    "d4_stratified_kfold",
    "d5_shuffle_rows",
    "e1_minmax_scale",
    "e2_standard_scale",
    "e4_pca_2d",
    "f7_logistic_regression",
    "f8_k_neighbors",
    "f12_density_clustering",
    "h1_confusion_matrix",
    "h9_roc_curve",
    "h10_roc_auc",
    "h11_roc_auc_ovr",
    "h12_cross_validate",
    "h14_train_test_metrics",
    "h16_silhouette_merged_points",
    "h16_silhouette_squared",
    "h19_adjusted_rand",
    "i1_shap_linear",
    "i4_shap_top_features",
    "j1_results_report",
    "l6_quality_report",
    "m3_latest_run",
    "m5_run_history",
    "s1_emit_on_change",
    "s2_latest_progress",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    known, _ = load()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    known["s2_latest_progress"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # the whole result is computed and dropped: no column or row is optimised away
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
