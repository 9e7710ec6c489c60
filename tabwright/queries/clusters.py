"""Cluster measures over ``embeddings`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import cluster_metrics as K
from tabwright.operators import metrics as M
from tabwright.queries.registry import query, rounded, table

DIMS = 64
# the given label is the truth; the strongest of four directions is the cluster
VEC_SQL = (
    "WITH e AS (SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(DIMS))
    + """ FROM embeddings),
p AS (SELECT *, CASE WHEN f0 >= greatest(f1, f2, f3) THEN 0 WHEN f1 >= greatest(f2, f3) THEN 1 WHEN f2 >= f3 THEN 2 ELSE 3 END AS cluster FROM e)
"""
)
FEATURES = [f"f{i}" for i in range(DIMS)]


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMS)]
    )
    f = [F.col(f"f{i}") for i in range(4)]
    return e.withColumn(
        "cluster",
        F.when(f[0] >= F.greatest(f[1], f[2], f[3]), 0)
        .when(f[1] >= F.greatest(f[2], f[3]), 1)
        .when(f[2] >= f[3], 2)
        .otherwise(3),
    )


@query("h15_contingency", VEC_SQL + "SELECT label, cluster, count(*) AS n FROM p GROUP BY 1, 2")
def contingency(spark, sf):
    return M.contingency(vectors(spark, sf))


def _dist(a: str, b: str, dims: int = DIMS) -> str:
    return "sqrt(" + " + ".join(f"({a}.f{i} - {b}.f{i}) ^ 2" for i in range(dims)) + ")"


SILHOUETTE_SQL = (
    VEC_SQL
    + f"""
, d AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum({_dist("a", "b")}) AS t, count(*) AS n
        FROM p a, p b GROUP BY 1, 2, 3)
, s AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other THEN t / nullif(n - 1, 0) END) AS a,
               min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM s"""
)


@query("h16_silhouette", SILHOUETTE_SQL)
def silhouette(spark, sf):
    return rounded(K.silhouette(vectors(spark, sf), FEATURES))


# every line item, on a lattice of quantity, discount and tax
LATTICE_SQL = """
WITH w AS (SELECT CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS cluster,
                  l_quantity / 50 AS f0, l_discount * 10 AS f1, l_tax * 10 AS f2, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT cluster, sum(n) AS n, sum(n * f0) AS s0, sum(n * f1) AS s1, sum(n * f2) AS s2,
             sum(n * (f0 * f0 + f1 * f1 + f2 * f2)) AS q FROM w GROUP BY 1)
"""


def lattice(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") < 17, 0).when(F.col("l_quantity") < 34, 1).otherwise(2).alias("cluster"),
        (F.col("l_quantity") / 50).alias("f0"),
        (F.col("l_discount") * 10).alias("f1"),
        (F.col("l_tax") * 10).alias("f2"),
    )


@query(
    "h16_silhouette_merged_points",
    LATTICE_SQL
    + f"""
, d AS (SELECT a.cluster AS own, a.f0, a.f1, a.f2, a.n AS w, b.cluster AS other, sum(b.n * {_dist("a", "b", 3)}) AS t
        FROM w a, w b GROUP BY ALL)
, s AS (SELECT own, f0, f1, f2, w, max(CASE WHEN own = other THEN t / (c.n - 1) END) AS a,
               min(CASE WHEN own <> other THEN t / c.n END) AS b
        FROM d JOIN c ON c.cluster = d.other GROUP BY ALL)
SELECT round(sum(w * (b - a) / greatest(a, b)) / sum(w), 6) AS silhouette_score FROM s""",
)
def silhouette_merged(spark, sf):
    return rounded(K.silhouette(lattice(spark, sf), ["f0", "f1", "f2"]))


@query(
    "h16_silhouette_squared",
    LATTICE_SQL
    + """
, d AS (SELECT w.*, c.cluster AS other, c.n AS m,
               c.n * (f0 * f0 + f1 * f1 + f2 * f2) - 2 * (f0 * s0 + f1 * s1 + f2 * s2) + q AS t FROM w, c)
, s AS (SELECT cluster, f0, f1, f2, n, max(CASE WHEN cluster = other THEN t / (m - 1) END) AS a,
               min(CASE WHEN cluster <> other THEN t / m END) AS b FROM d GROUP BY ALL)
SELECT round(sum(n * (b - a) / greatest(a, b)) / sum(n), 6) AS silhouette_score FROM s""",
)
def silhouette_squared(spark, sf):
    return rounded(K.silhouette_squared(lattice(spark, sf), ["f0", "f1", "f2"]))


CENTROID_SQL = (
    VEC_SQL
    + ", c AS (SELECT cluster, count(*) AS n, "
    + ", ".join(f"avg(f{i}) AS f{i}" for i in range(DIMS))
    + " FROM p GROUP BY 1)"
)


DB_SQL = (
    CENTROID_SQL
    + f"""
, s AS (SELECT p.cluster, avg({_dist("p", "c")}) AS s FROM p JOIN c USING (cluster) GROUP BY 1)
, r AS (SELECT a.cluster, max((sa.s + sb.s) / {_dist("a", "b")}) AS r FROM c a JOIN c b ON a.cluster <> b.cluster
        JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin_score FROM r"""
)


@query("h17_davies_bouldin", DB_SQL)
def davies_bouldin(spark, sf):
    return rounded(K.davies_bouldin(vectors(spark, sf), FEATURES))


CH_SQL = (
    CENTROID_SQL
    + ", g AS (SELECT "
    + ", ".join(f"avg(f{i}) AS f{i}" for i in range(DIMS))
    + f""" FROM p)
, b AS (SELECT sum(c.n * {_dist("c", "g")} ^ 2) AS b, count(*) AS k FROM c, g)
, w AS (SELECT sum({_dist("p", "c")} ^ 2) AS w, count(*) AS n FROM p JOIN c USING (cluster))
SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz_score FROM b, w"""
)


@query("h18_calinski_harabasz", CH_SQL)
def calinski_harabasz(spark, sf):
    return rounded(K.calinski_harabasz(vectors(spark, sf), FEATURES), 4)


AGREE_SQL = (
    VEC_SQL
    + """
, nij AS (SELECT label, cluster, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY 1, 2)
, ai AS (SELECT label, sum(n) AS n FROM nij GROUP BY 1)
, bj AS (SELECT cluster, sum(n) AS n FROM nij GROUP BY 1)
, t AS (SELECT sum(n) AS n FROM ai)
, f AS (SELECT t.n, (SELECT sum(n * (n - 1) / 2) FROM nij) AS s, (SELECT sum(n * (n - 1) / 2) FROM ai) AS pa,
               (SELECT sum(n * (n - 1) / 2) FROM bj) AS pb,
               (SELECT sum(x.n / t.n * ln(t.n * x.n / ai.n / bj.n)) FROM nij x JOIN ai USING (label) JOIN bj USING (cluster), t) AS mi,
               (SELECT -sum(ai.n / t.n * ln(ai.n / t.n)) FROM ai, t) AS ha, (SELECT -sum(bj.n / t.n * ln(bj.n / t.n)) FROM bj, t) AS hb FROM t)
"""
)


def agreement(name: str, column: str, expr: str):
    @query(name, AGREE_SQL + f"SELECT round({expr}, 6) AS {column} FROM f")
    def run(spark, sf):
        return rounded(K.agreement(vectors(spark, sf)).select(column))


agreement(
    "h19_adjusted_rand",
    "adjusted_rand",
    "(s - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2))",
)
agreement("h20_normalized_mutual_info", "normalized_mutual_info", "mi / ((ha + hb) / 2)")
agreement("h21_v_measure", "v_measure", "2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)")
agreement("h22_fowlkes_mallows", "fowlkes_mallows", "s / sqrt(pa * pb)")


# all ways to give the four clusters different labels; the best total wins
ALIGN_SQL = (
    VEC_SQL
    + """
, n AS (SELECT cluster, label, count(*) AS n FROM p GROUP BY 1, 2), l AS (SELECT DISTINCT label FROM p)
, m AS (SELECT a.label AS l0, b.label AS l1, c.label AS l2, d.label AS l3,
               coalesce(n0.n, 0) + coalesce(n1.n, 0) + coalesce(n2.n, 0) + coalesce(n3.n, 0) AS total
        FROM l a JOIN l b ON b.label <> a.label JOIN l c ON c.label NOT IN (a.label, b.label) JOIN l d ON d.label NOT IN (a.label, b.label, c.label)
        LEFT JOIN n n0 ON n0.cluster = 0 AND n0.label = a.label LEFT JOIN n n1 ON n1.cluster = 1 AND n1.label = b.label
        LEFT JOIN n n2 ON n2.cluster = 2 AND n2.label = c.label LEFT JOIN n n3 ON n3.cluster = 3 AND n3.label = d.label)
SELECT (SELECT max(total) FROM m) AS matches, (SELECT count(*) FROM p) AS n_rows, 4 AS n_clusters, 4 AS n_labels
"""
)


@query("h23_align_clusters")
def align(spark, sf):
    return K.align_clusters(vectors(spark, sf))[1].select("vec_id", "label", "cluster", "aligned")


@query("h23_align_clusters_totals", ALIGN_SQL)
def align_totals(spark, sf):
    """Rows that match after aligning; every cluster has a label of its own. Equal totals may come from other pairings."""
    found = K.align_clusters(vectors(spark, sf))[1]
    return found.agg(
        F.count_if(F.col("label") == F.col("aligned")).alias("matches"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("cluster").cast("int").alias("n_clusters"), F.count_distinct("aligned").cast("int").alias("n_labels"),
    )


# run rows from events: one (run, model) pair per event
MODEL_OF = (
    "CASE event_type WHEN 'click' THEN 'randomforest' WHEN 'view' THEN 'logisticregression' "
    "WHEN 'signup' THEN 'kmeans' WHEN 'purchase' THEN 'hdbscan' ELSE 'xgboost' END"
)


@query(
    "h24_model_kind_counts",
    f"""
SELECT user_id, count(*) FILTER (WHERE model IN ('kmeans', 'hdbscan')) AS n_clustering,
       count(*) FILTER (WHERE model NOT IN ('kmeans', 'hdbscan')) AS n_supervised
FROM (SELECT user_id, {MODEL_OF} AS model FROM events) GROUP BY 1""",
)
def model_kinds(spark, sf):
    runs = table(spark, sf, "events").select("user_id", F.expr(MODEL_OF).alias("model"))
    return M.model_kind_counts(runs, ["user_id"])


LABELS_SQL = """
WITH l AS (SELECT vec_id, 'kmeans' AS model, cluster AS label FROM p
  UNION ALL SELECT vec_id, 'hdbscan', CASE WHEN f0 > 0.1 THEN cluster ELSE -1 END FROM p
  UNION ALL SELECT vec_id, 'spectralclustering', -1 FROM p)
"""


def label_rows(spark, sf):
    v = vectors(spark, sf)
    return v.select(
        "vec_id",
        F.explode(
            F.array(
                F.struct(F.lit("kmeans").alias("model"), F.col("cluster").alias("label")),
                F.struct(F.lit("hdbscan").alias("model"), F.when(F.col("f0") > 0.1, F.col("cluster")).otherwise(-1).alias("label")),
                F.struct(F.lit("spectralclustering").alias("model"), F.lit(-1).alias("label")),
            )
        ).alias("r"),
    ).select("vec_id", "r.model", "r.label")


@query(
    "h25_cluster_sizes",
    VEC_SQL
    + LABELS_SQL.replace("WITH l", ", l", 1)
    + """
, n AS (SELECT model, label, count(*) AS n FROM l GROUP BY 1, 2)
SELECT model, label, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY model), 6) AS share,
       bool_and(label = -1) OVER (PARTITION BY model) AS all_noise FROM n""",
)
def cluster_sizes(spark, sf):
    return rounded(K.cluster_sizes(label_rows(spark, sf)))
