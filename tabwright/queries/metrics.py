"""Classification measures of rule-made predictions over ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import metrics as M
from tabwright.operators import sampling as S
from tabwright.queries.registry import query, rounded, table

# Three fixed rules score "status is F"; coarse scores give ties.
PRED_SQL = """
WITH p0 AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         CASE WHEN substr(md5('42|' || o_orderkey), 1, 1) < '4' THEN 'test' ELSE 'train' END AS dataset,
         round(o_totalprice / 600000, 4) AS s1, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 8 AS s2,
         CAST(o_custkey % 64 AS DOUBLE) / 64 AS s3 FROM orders),
pred AS (
  SELECT 'price' AS model, row_id, label, dataset, s1 AS score, CASE WHEN s1 >= 0.4E0 THEN 1 ELSE 0 END AS prediction FROM p0
  UNION ALL SELECT 'priority', row_id, label, dataset, s2, CASE WHEN s2 >= 0.5E0 THEN 1 ELSE 0 END FROM p0
  UNION ALL SELECT 'customer', row_id, label, dataset, s3, CASE WHEN s3 >= 0.75E0 THEN 1 ELSE 0 END FROM p0),
cell AS (SELECT model, count(*) AS n, CAST(sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
  CAST(sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
  CAST(sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
  CAST(sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM pred GROUP BY model)
"""
# macro measures of a 3-class rule pair on lineitem
MULTI_SQL = """
WITH mp AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, model,
         CASE WHEN model = 'quantity' THEN CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END
              ELSE CASE WHEN l_discount < 0.03 THEN 0 ELSE 1 END END AS prediction,
         l_quantity, l_discount, l_tax
  FROM lineitem, (VALUES ('quantity'), ('discount')) v(model)),
tot AS (SELECT model, count(*) AS n FROM mp GROUP BY model),
cls AS (SELECT model, k, n, CAST(sum(CASE WHEN label = k AND prediction = k THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
          CAST(sum(CASE WHEN label = k AND prediction <> k THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
          CAST(sum(CASE WHEN label <> k AND prediction = k THEN 1 ELSE 0 END) AS DOUBLE) AS fp
        FROM mp JOIN tot USING (model), (VALUES (0), (1), (2)) c(k) GROUP BY model, k, n),
rate AS (SELECT model, k, n, tp, fn, fp, n - tp - fn - fp AS tn,
           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
           CASE WHEN n - tp - fn > 0 THEN (n - tp - fn - fp) / (n - tp - fn) END AS spec,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
           CASE WHEN n - tp - fp > 0 THEN (n - tp - fn - fp) / (n - tp - fp) END AS npv,
           CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cls)
"""


def predictions(spark, sf):
    o = table(spark, sf, "orders")
    base = o.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(F.substring(F.md5(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string"))), 1, 1) < "4", "test")
        .otherwise("train")
        .alias("dataset"),
        F.explode(
            F.array(
                F.struct(F.lit("price").alias("model"), F.round(F.col("o_totalprice") / 600000, 4).alias("score"), F.lit(0.4).alias("cut")),
                F.struct(F.lit("priority").alias("model"), (F.substring("o_orderpriority", 1, 1).cast("double") / 8).alias("score"), F.lit(0.5).alias("cut")),
                F.struct(F.lit("customer").alias("model"), ((F.col("o_custkey") % 64).cast("double") / 64).alias("score"), F.lit(0.75).alias("cut")),
            )
        ).alias("r"),
    )
    return base.select(
        "r.model", "row_id", "label", "dataset", "r.score", (F.col("r.score") >= F.col("r.cut")).cast("int").alias("prediction")
    )


def multi_predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount")
    flag = F.col("l_returnflag")
    return li.select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        F.array(1 - q / 51, d * 10, F.col("l_tax") * 10).alias("prob"),
        F.explode(
            F.array(
                F.struct(F.lit("quantity").alias("model"), F.when(q < 17, 0).when(q < 34, 1).otherwise(2).alias("prediction")),
                F.struct(F.lit("discount").alias("model"), F.when(d < 0.03, 0).otherwise(1).alias("prediction")),
            )
        ).alias("r"),
    ).select("r.model", "label", "r.prediction", "prob")


def measure(name: str, binary: str, multi: str, column: str):
    """One measure of both prediction tables, each beside its SQL."""
    sql = (
        PRED_SQL
        + MULTI_SQL.replace("WITH mp", ", mp", 1)
        + f"SELECT model, round({binary}, 6) AS {column} FROM cell UNION ALL SELECT model, {multi} FROM rate GROUP BY model"
    )

    @query(name, sql)
    def run(spark, sf):
        both = M.classification_metrics(predictions(spark, sf)).unionByName(
            M.classification_metrics(multi_predictions(spark, sf))
        )
        return rounded(both.select("model", column))


@query(
    "h1_confusion_matrix",
    MULTI_SQL
    + """
SELECT model, a.k AS label, b.k AS prediction, count(mp.label) AS n
FROM (VALUES ('quantity'), ('discount')) m(model), (VALUES (0), (1), (2)) a(k), (VALUES (0), (1), (2)) b(k)
LEFT JOIN mp ON mp.model = m.model AND mp.label = a.k AND mp.prediction = b.k GROUP BY 1, 2, 3""".replace(
        "FROM (VALUES ('quantity'), ('discount')) m(model), (VALUES (0), (1), (2)) a(k), (VALUES (0), (1), (2)) b(k)\nLEFT JOIN mp ON mp.model = m.model",
        "FROM (SELECT * FROM (VALUES ('quantity'), ('discount')) v(model), (VALUES (0), (1), (2)) a(ka), (VALUES (0), (1), (2)) b(kb)) m\nLEFT JOIN mp ON mp.model = m.model",
    )
    .replace("a.k", "m.ka")
    .replace("b.k", "m.kb")
    .replace("SELECT model, m.ka", "SELECT m.model, m.ka"),
)
def confusion(spark, sf):
    return M.confusion_matrix(multi_predictions(spark, sf))


@query(
    "h2_accuracy",
    PRED_SQL + "SELECT model, round(avg(CAST(label = prediction AS INT)), 6) AS accuracy FROM pred GROUP BY model",
)
def accuracy(spark, sf):
    return rounded(M.accuracy(predictions(spark, sf)))


measure("h3_sensitivity", "tp / (tp + fn)", "round(avg(recall), 6)", "sensitivity")
measure("h4_specificity", "tn / (tn + fp)", "round(avg(spec), 6)", "specificity")
measure("h5_ppv", "tp / (tp + fp)", "round(avg(prec), 6)", "ppv")
measure("h6_npv", "tn / (tn + fn)", "round(avg(npv), 6)", "npv")
measure("h7_f1", "2 * tp / (2 * tp + fp + fn)", "round(avg(f1), 6)", "f1")
measure(
    "h8_cohen_kappa",
    "((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n / n)"
    " / (1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n / n)",
    "round((sum(tp) / max(n) - sum((tp + fn) * (tp + fp)) / max(n) / max(n)) / (1 - sum((tp + fn) * (tp + fp)) / max(n) / max(n)), 6)",
    "kappa",
)

ROC_SQL = (
    PRED_SQL
    + """
, st AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY 1, 2)
, cum AS (SELECT model, score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
                 sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q
          FROM st WINDOW w AS (PARTITION BY model ORDER BY score DESC))
"""
)
AUC = "round(sum(CAST(neg AS DOUBLE) * (cp - pos / 2)) / (CAST(max(p) AS DOUBLE) * max(q)), 6)"


@query(
    "h9_roc_curve",
    ROC_SQL
    + """
SELECT model, round(score, 6) AS threshold, round(CAST(cn AS DOUBLE) / q, 6) AS fpr, round(CAST(cp AS DOUBLE) / p, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0E0, 0.0E0 FROM st""",
)
def roc(spark, sf):
    return rounded(M.roc_curve(predictions(spark, sf)))


@query("h10_roc_auc", ROC_SQL + f"SELECT model, {AUC} AS auc FROM cum GROUP BY model")
def auc(spark, sf):
    return rounded(M.roc_auc(predictions(spark, sf)))


@query(
    "h11_roc_auc_ovr",
    MULTI_SQL
    + """
, s AS (SELECT model, k, CASE WHEN label = k THEN 1 ELSE 0 END AS y,
               CASE k WHEN 0 THEN 1 - l_quantity / 51 WHEN 1 THEN l_discount * 10 ELSE l_tax * 10 END AS score
        FROM mp, (VALUES (0), (1), (2)) c(k))
, st AS (SELECT model, k, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2, 3)
, cum AS (SELECT model, k, pos, neg, sum(pos) OVER (PARTITION BY model, k ORDER BY score DESC) AS cp FROM st)
, a AS (SELECT model, k, sum(CAST(neg AS DOUBLE) * (cp - pos / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM cum GROUP BY 1, 2)
SELECT model, round(avg(auc), 6) AS auc FROM a GROUP BY model""",
)
def auc_ovr(spark, sf):
    return rounded(M.roc_auc_ovr(multi_predictions(spark, sf)))


def folded(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    folds = S.stratified_folds(o, "y", "o_orderkey").select(F.col("o_orderkey").alias("row_id"), "repeat", "fold")
    return predictions(spark, sf).join(folds, "row_id")


@query(
    "h12_cross_validate",
    PRED_SQL
    + """
, f AS (SELECT *, (row_number() OVER (PARTITION BY model, label ORDER BY md5('42|0|' || row_id), row_id) - 1) % 5 AS fold FROM pred)
, st AS (SELECT model, fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM f GROUP BY 1, 2, 3)
, cum AS (SELECT *, sum(pos) OVER (PARTITION BY model, fold ORDER BY score DESC) AS cp FROM st)
, a AS (SELECT model, fold, sum(CAST(neg AS DOUBLE) * (cp - pos / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM cum GROUP BY 1, 2)
, g AS (SELECT model, fold, count(*) AS n, CAST(sum(label * prediction) AS DOUBLE) AS tp, CAST(sum(label * (1 - prediction)) AS DOUBLE) AS fn,
               CAST(sum((1 - label) * prediction) AS DOUBLE) AS fp, CAST(sum((1 - label) * (1 - prediction)) AS DOUBLE) AS tn FROM f GROUP BY 1, 2)
, m AS (SELECT model, 'auc' AS metric, auc AS v FROM a
  UNION ALL SELECT model, 'accuracy', (tp + tn) / n FROM g
  UNION ALL SELECT model, 'sensitivity', tp / (tp + fn) FROM g
  UNION ALL SELECT model, 'specificity', tn / (tn + fp) FROM g
  UNION ALL SELECT model, 'ppv', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END FROM g
  UNION ALL SELECT model, 'npv', CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END FROM g
  UNION ALL SELECT model, 'f1', CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END FROM g)
SELECT model, metric, round(avg(v), 6) AS value, round(1.96 * stddev_pop(v) / sqrt(count(*)), 6) AS moe FROM m GROUP BY 1, 2""",
)
def cross_validate(spark, sf):
    return rounded(M.cross_validate_predictions(folded(spark, sf)))


@query(
    "h13_custom_specificity_scorer",
    PRED_SQL + "SELECT round(tn / (tn + fp), 6) AS specificity FROM cell WHERE model = 'price'",
)
def scorer(spark, sf):
    price = predictions(spark, sf).where("model = 'price'")
    value = M.SpecificityEvaluator(labelCol="label", predictionCol="prediction").evaluate(price)
    return rounded(spark.createDataFrame([(value,)], "specificity double"))


@query(
    "h14_train_test_metrics",
    ROC_SQL.replace("model, score, sum", "model, dataset, score, sum")
    .replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
    .replace("PARTITION BY model", "PARTITION BY model, dataset")
    .replace("cum AS (SELECT model,", "cum AS (SELECT model, dataset,")
    + f"""
, a AS (SELECT model, dataset, {AUC} AS auc FROM cum GROUP BY 1, 2)
, g AS (SELECT model, dataset, count(*) AS n, CAST(sum(label * prediction) AS DOUBLE) AS tp, CAST(sum(label * (1 - prediction)) AS DOUBLE) AS fn,
               CAST(sum((1 - label) * prediction) AS DOUBLE) AS fp, CAST(sum((1 - label) * (1 - prediction)) AS DOUBLE) AS tn FROM pred GROUP BY 1, 2)
SELECT model, dataset, n, auc, round((tp + tn) / n, 6) AS accuracy,
       round(((tp + tn) / n - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n / n) / (1 - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n / n), 6) AS kappa,
       round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS ppv,
       round(tn / (tn + fn), 6) AS npv, round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM g JOIN a USING (model, dataset)""",
)
def train_test(spark, sf):
    return rounded(M.train_test_metrics(predictions(spark, sf)))
