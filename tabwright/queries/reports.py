"""Report tables over measured predictions, attributions and synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import explain as E
from tabwright.operators import metrics as M
from tabwright.operators import report as R
from tabwright.operators import synth as Y
from tabwright.operators import tuning as G
from tabwright.queries.clusters import LABELS_SQL, VEC_SQL, label_rows
from tabwright.queries.metrics import AUC, ROC_SQL, folded, predictions
from tabwright.queries.registry import SQL, query, rounded, table

# per (model, dataset) measures, then one column per measure
TT_SQL = SQL["h14_train_test_metrics"]
WIDE_SQL = (
    "WITH tt AS ("
    + TT_SQL
    + """),
wide AS (SELECT a.model, a.auc AS test_auc, a.accuracy AS test_acc, a.sensitivity AS test_sensitivity, a.specificity AS test_specificity,
    a.npv AS test_npv, a.ppv AS test_ppv, a.f1 AS test_f1score, a.kappa AS test_kappa, b.auc AS trt_auc, b.accuracy AS trt_acc,
    b.sensitivity AS trt_sensitivity, b.specificity AS trt_specificity, b.npv AS trt_npv, b.ppv AS trt_ppv, b.f1 AS trt_f1score,
    b.kappa AS trt_kappa, b.n AS n_train, a.n AS n_test
  FROM tt a JOIN tt b ON a.model = b.model AND a.dataset = 'test' AND b.dataset = 'train')
"""
)
CV_SQL = SQL["h12_cross_validate"]
NAMES = ("price", "priority", "customer")


def long_metrics(spark, sf):
    tt = rounded(M.train_test_metrics(predictions(spark, sf)))
    counts = tt.select(
        "model",
        F.when(F.col("dataset") == "test", "n_test").otherwise("n_train").alias("metric"),
        F.col("n").cast("double").alias("value"),
    )
    return R.long_metrics(tt).unionByName(counts)


def numeric_report(spark, sf):
    cols = [x for x in R.report_columns() if not x.startswith("cvt_")]
    return long_metrics(spark, sf).groupBy("model").pivot("metric", cols).agg(F.first("value"))


def _cell(x: str) -> str:
    return f"coalesce(CAST(round({x}, 3) + 0.0 AS VARCHAR), 'N/A') AS {x}"


SHOWN = [x for x in R.report_columns() if not x.startswith(("cvt_", "n_"))]
CVT = {f"cvt_{s}": m for m, s in R.SUFFIX.items() if m != "kappa"}


@query(
    "j1_results_report",
    WIDE_SQL
    + ", cv AS ("
    + CV_SQL
    + ")\nSELECT model, '[o_totalprice-o_orderpriority-o_custkey]' AS features, CAST(n_train AS VARCHAR) AS n_train, CAST(n_test AS VARCHAR) AS n_test, "
    + ", ".join(_cell(x) for x in SHOWN)
    + ", "
    + ", ".join(
        f"(SELECT CAST(round(value, 3) AS VARCHAR) || ' ± ' || CAST(round(moe, 3) AS VARCHAR) FROM cv WHERE cv.model = wide.model AND metric = '{m}') AS {k}"
        for k, m in CVT.items()
    )
    + " FROM wide",
)
def results_report(spark, sf):
    cv = rounded(M.cross_validate_predictions(folded(spark, sf)))
    key = "[o_totalprice-o_orderpriority-o_custkey]"
    return R.results_report(long_metrics(spark, sf), cv, key, R.report_columns())


@query(
    "j2_parse_mean_error",
    "WITH cv AS (" + CV_SQL + """)
SELECT model, metric, round(value, 3) AS cell, round(moe, 3) AS cell_err FROM cv
UNION ALL SELECT DISTINCT model, 'none', 0.0E0, 0.0E0 FROM cv""",
)
def parse_mean_error(spark, sf):
    from tabwright.functions.exprs import mean_error_text

    cv = rounded(M.cross_validate_predictions(folded(spark, sf)))
    text = cv.select("model", "metric", mean_error_text(F.col("value"), F.col("moe")).alias("cell"))
    none = cv.select("model").distinct().select("model", F.lit("none").alias("metric"), F.lit("N/A").alias("cell"))
    return R.parse_mean_error(text.unionByName(none), ["cell"])


@query(
    "j3_true_false_rates",
    WIDE_SQL
    + """
SELECT model, test_sensitivity AS tpr, round(1 - test_specificity, 6) AS fpr, test_specificity AS tnr, round(1 - test_sensitivity, 6) AS fnr FROM wide""",
)
def true_false(spark, sf):
    return rounded(R.true_false_rates(numeric_report(spark, sf)))


@query(
    "j4_auc_comparison",
    WIDE_SQL
    + ", cv AS ("
    + CV_SQL
    + ") SELECT wide.model, test_auc, trt_auc, cv.value AS cvt_auc, cv.moe AS cvt_auc_err FROM wide JOIN cv ON cv.model = wide.model AND cv.metric = 'auc'",
)
def auc_comparison(spark, sf):
    cv = rounded(M.cross_validate_predictions(folded(spark, sf))).where("metric = 'auc'")
    report = numeric_report(spark, sf).join(
        cv.select("model", F.col("value").alias("cvt_auc"), F.col("moe").alias("cvt_auc_err")), "model"
    )
    return rounded(R.auc_comparison(report))


HEAT = ("test_auc", "test_acc", "test_sensitivity", "test_specificity", "test_npv", "test_ppv", "test_f1score")


@query(
    "j5_metric_heatmap",
    WIDE_SQL
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, "
        + ", ".join(f"max(CASE WHEN model = '{n}' THEN {m} END) AS {n}" for n in NAMES)
        + " FROM wide"
        for m in HEAT
    ),
)
def heatmap(spark, sf):
    return rounded(R.metric_heatmap(numeric_report(spark, sf), HEAT, NAMES))


# each line status as a "model" with three scores, one of which is better when low
CLUSTER_REPORT_SQL = """
WITH r AS (SELECT l_returnflag AS model, avg(l_quantity) AS silhouette_score, avg(l_extendedprice) AS calinski_harabasz_score,
                  avg(l_tax) AS davies_bouldin_score FROM lineitem GROUP BY 1)
"""
UNSUP = ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score")


def cluster_report(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_quantity").alias("silhouette_score"),
        F.avg("l_extendedprice").alias("calinski_harabasz_score"),
        F.avg("l_tax").alias("davies_bouldin_score"),
    )


def _scaled(m: str, n: str) -> str:
    v = f"max(CASE WHEN model = '{n}' THEN {m} END)"
    s = f"({v} - min({m})) / (max({m}) - min({m}))"
    return f"round({'1 - ' + s if m.startswith('davies') else s}, 4) + 0.0 AS \"{n}\""


@query(
    "j5_metric_heatmap_clusters",
    CLUSTER_REPORT_SQL
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(_scaled(m, n) for n in "ANR") + " FROM r" for m in UNSUP
    ),
)
def heatmap_clusters(spark, sf):
    return rounded(R.metric_heatmap(cluster_report(spark, sf), UNSUP, ["A", "N", "R"], supervised=False), 4)


@query(
    "j6_best_per_metric",
    WIDE_SQL
    + """
, l AS ("""
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, model, {m} AS value FROM wide" for m in HEAT)
    + """)
SELECT metric, model, value FROM l QUALIFY rank() OVER (PARTITION BY metric ORDER BY value DESC) = 1""",
)
def best_per_metric(spark, sf):
    return rounded(R.best_per_metric(numeric_report(spark, sf), HEAT))


@query(
    "j7_roc_overlay",
    ROC_SQL
    + f"""
, a AS (SELECT model, {AUC} AS auc FROM cum GROUP BY model)
SELECT model, auc, round(score, 6) AS threshold, round(CAST(cn AS DOUBLE) / q, 6) AS fpr, round(CAST(cp AS DOUBLE) / p, 6) AS tpr FROM cum JOIN a USING (model)
UNION ALL SELECT model, auc, NULL, 0.0E0, 0.0E0 FROM a""",
)
def roc_overlay(spark, sf):
    return rounded(R.roc_overlay(predictions(spark, sf)))


# trials: cut points on price, scored by macro F1 of "status is F"
TRIAL_SQL = """
WITH t AS (SELECT o_orderpriority AS model, CAST(cut AS INT) AS trial, o_orderstatus = 'F' AS y, o_totalprice >= cut * 50000 AS p
           FROM orders, generate_series(1, 8) g(cut)),
s AS (SELECT model, trial, round(avg(CAST(y = p AS INT)), 6) AS score FROM t GROUP BY 1, 2)
"""


def trials(spark, sf):
    o = table(spark, sf, "orders").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(8))))
    pred = o.select(
        F.col("o_orderpriority").alias("model"),
        "trial",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") >= F.col("trial") * 50000).cast("int").alias("prediction"),
    )
    return rounded(G.goal_scores(pred, "accuracy", ["model", "trial"]))


@query(
    "g5_best_trial",
    TRIAL_SQL
    + """SELECT model, trial, score, 'cut=' || trial * 50000 AS params FROM s
QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, trial) = 1""",
)
def best_trial(spark, sf):
    t = trials(spark, sf).withColumn("params", F.concat(F.lit("cut="), (F.col("trial") * 50000).cast("string")))
    return G.best_trial(t, "accuracy", ["model"])


@query(
    "j8_best_score_ranking",
    TRIAL_SQL + "SELECT model, round(avg(score), 6) AS mean FROM s GROUP BY model",
)
def ranking(spark, sf):
    return rounded(R.best_score_ranking(trials(spark, sf).withColumnRenamed("score", "best_score")))


@query(
    "j9_label_table",
    VEC_SQL
    + LABELS_SQL.replace("WITH l", ", l", 1)
    + """
SELECT vec_id, max(CASE WHEN model = 'kmeans' THEN label END) AS "kmeans labels", max(CASE WHEN model = 'hdbscan' THEN label END) AS "hdbscan labels",
       max(CASE WHEN model = 'spectralclustering' THEN label END) AS "spectralclustering labels" FROM l GROUP BY 1""",
)
def label_table(spark, sf):
    return R.label_table(label_rows(spark, sf), "vec_id", ["kmeans", "hdbscan", "spectralclustering"])


def _text(s: str) -> str:
    return s.replace("'", "''")


@query(
    "j10_metric_definitions",
    WIDE_SQL
    + ", d(metric, description) AS (VALUES "
    + ", ".join(f"('{k}', '{_text(v)}')" for k, v in R.METRIC_DEFINITIONS.items())
    + "), l AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, model, {m} AS value FROM wide" for m in SHOWN)
    + " UNION ALL SELECT 'n_train', model, n_train FROM wide UNION ALL SELECT 'n_test', model, n_test FROM wide"
    + ") SELECT metric, model, value, description FROM l LEFT JOIN d USING (metric)",
)
def definitions(spark, sf):
    return rounded(R.describe_metrics(long_metrics(spark, sf)))


# a fixed linear score on orders
WEIGHTS = {"o_totalprice": 0.00002, "o_custkey": -0.003, "day": 0.001}
SHAP_SQL = """
WITH x AS (SELECT o_orderkey AS row_id, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey,
                  CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS DOUBLE) AS day FROM orders),
m AS (SELECT avg(o_totalprice) AS a, avg(o_custkey) AS b, avg(day) AS c FROM x),
s AS (SELECT row_id, 'o_totalprice' AS feature, round((o_totalprice - a) * 0.00002E0, 4) + 0.0 AS shap, o_totalprice AS feature_value FROM x, m
  UNION ALL SELECT row_id, 'o_custkey', round((o_custkey - b) * -0.003E0, 4) + 0.0, o_custkey FROM x, m
  UNION ALL SELECT row_id, 'day', round((day - c) * 0.001E0, 4) + 0.0, day FROM x, m)
"""


def shap_input(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        "o_totalprice",
        F.col("o_custkey").cast("double").alias("o_custkey"),
        F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("day"),
    )


@query("i1_shap_linear", SHAP_SQL + "SELECT row_id, feature, shap FROM s")
def shap_linear(spark, sf):
    return rounded(E.linear_shap(shap_input(spark, sf), WEIGHTS, "row_id"), 4)


@query(
    "i2_shap_wide",
    SHAP_SQL
    + " SELECT row_id, "
    + ", ".join(f"max(CASE WHEN feature = '{f}' THEN shap END) AS {f}" for f in WEIGHTS)
    + " FROM s GROUP BY 1",
)
def shap_wide(spark, sf):
    return rounded(E.shap_wide(E.linear_shap(shap_input(spark, sf), WEIGHTS, "row_id"), list(WEIGHTS)), 4)


@query(
    "i3_shap_importance",
    SHAP_SQL
    + "SELECT feature, round(avg(abs(shap)), 4) AS importance FROM s GROUP BY 1 UNION ALL SELECT 'absent', -1.0E0",
)
def shap_importance(spark, sf):
    shap = E.linear_shap(shap_input(spark, sf), WEIGHTS, "row_id")
    return rounded(E.shap_importance(shap, [*WEIGHTS, "absent"]), 4)


@query(
    "i4_shap_top_features",
    SHAP_SQL
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, feature) AS rn FROM s)
SELECT row_id, CAST(rn AS INT) AS place, feature, round(shap, 6) AS shap, round(feature_value, 6) AS feature_value FROM r WHERE rn = 1
UNION ALL SELECT row_id, 2, 'Avg. of ' || count(*) || ' other columns', round(avg(shap), 6) + 0.0, round(avg(feature_value), 6) FROM r WHERE rn > 1 GROUP BY row_id""",
)
def shap_top(spark, sf):
    x = shap_input(spark, sf)
    shap = rounded(E.linear_shap(x, WEIGHTS, "row_id"), 4)
    values = x.unpivot(["row_id"], list(WEIGHTS), "feature", "feature_value")
    return rounded(E.shap_top_features(shap, values, top=1))


@query(
    "l1_table_metadata",
    """
SELECT 'l_quantity' AS "column", 'numerical' AS sdtype, 'Float' AS representation, count(l_quantity) AS n_values FROM lineitem
UNION ALL SELECT 'l_linenumber', 'numerical', 'Int64', count(l_linenumber) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'numerical', NULL, count(l_returnflag) FROM lineitem
UNION ALL SELECT 'is_open', 'boolean', NULL, count(l_linestatus) FROM lineitem""",
)
def table_metadata(spark, sf):
    """Column kinds beside the number of values each column holds."""
    d = table(spark, sf, "lineitem").select(
        "l_quantity", "l_linenumber", "l_returnflag", (F.col("l_linestatus") == "O").alias("is_open")
    )
    counts = d.agg(*[F.count(x).alias(x) for x in d.columns]).unpivot([], d.columns, "column", "n_values")
    return Y.table_metadata(d).join(counts, "column")


@query(
    "l6_quality_report",
    """
WITH r AS (SELECT 'q' AS c, l_quantity AS v, 1 AS r, 0 AS s FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'q', l_quantity, 0, 1 FROM lineitem WHERE l_linestatus <> 'O'
  UNION ALL SELECT 'p', l_extendedprice, 1, 0 FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'p', l_extendedprice, 0, 1 FROM lineitem WHERE l_linestatus <> 'O'),
g AS (SELECT c, v, sum(r) AS r, sum(s) AS s FROM r GROUP BY 1, 2),
f AS (SELECT c, CAST(sum(r) OVER w AS DOUBLE) / sum(r) OVER (PARTITION BY c) AS fr, CAST(sum(s) OVER w AS DOUBLE) / sum(s) OVER (PARTITION BY c) AS fs
      FROM g WINDOW w AS (PARTITION BY c ORDER BY v)),
k AS (SELECT CASE c WHEN 'q' THEN 'l_quantity' ELSE 'l_extendedprice' END AS "column", 'KSComplement' AS metric, 1 - max(abs(fr - fs)) AS quality_score FROM f GROUP BY c),
n AS (SELECT l_returnflag AS t, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS r, CAST(count(*) FILTER (WHERE l_linestatus <> 'O') AS DOUBLE) AS s FROM lineitem GROUP BY 1),
tv AS (SELECT 'l_returnflag', 'TVComplement', 1 - sum(abs(r / (SELECT sum(r) FROM n) - s / (SELECT sum(s) FROM n))) / 2 FROM n),
a AS (SELECT * FROM k UNION ALL SELECT * FROM tv), s AS (SELECT avg(quality_score) AS s FROM a),
t AS (SELECT 1 - abs(corr(l_quantity, l_extendedprice) FILTER (WHERE l_linestatus = 'O') - corr(l_quantity, l_extendedprice) FILTER (WHERE l_linestatus <> 'O')) / 2 AS t FROM lineitem)
SELECT "column", metric, round(quality_score, 6) AS quality_score FROM a
UNION ALL SELECT 'overall', 'mean', round((s + t) / 2, 6) FROM s, t
UNION ALL SELECT 'shapes', 'mean', round(s, 6) FROM s UNION ALL SELECT 'pairs', 'mean', round(t, 6) FROM t""",
)
def quality(spark, sf):
    li = table(spark, sf, "lineitem")
    real, other = li.where("l_linestatus = 'O'"), li.where("l_linestatus <> 'O'")
    return rounded(Y.quality_report(real, other, ["l_quantity", "l_extendedprice", "l_returnflag"]))


