"""Splits, folds, resampling and scaling over ``labels``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import sampling as S
from tabwright.operators import scale as X
from tabwright.queries.registry import query, rounded, table

# class sizes, quotas by largest remainder, rows ranked by seeded hash
SPLIT_SQL = """
WITH n AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1),
q0 AS (SELECT y, n, CAST(floor(round(n * 0.2E0, 9)) AS BIGINT) AS whole,
              round(n * 0.2E0 - floor(round(n * 0.2E0, 9)), 9) AS rest,
              CAST(ceil(round((SELECT sum(n) FROM n) * 0.2E0, 9)) AS BIGINT) AS total FROM n),
q AS (SELECT y, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, y)
                             <= total - (SELECT sum(whole) FROM q0) THEN 1 ELSE 0 END AS quota FROM q0),
r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (
        PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM orders)
"""


@query(
    "d1_stratified_split",
    SPLIT_SQL + "SELECT o_orderkey, o_orderstatus, rn <= quota AS is_test FROM r JOIN q ON q.y = r.o_orderstatus",
)
def split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_split(o, "o_orderstatus", "o_orderkey")


RANKED_LABELS = """
WITH r AS (SELECT doc_id, quality, row_number() OVER (
             PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS rn,
           count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT min(n) AS least, max(n) AS most FROM r)
"""


@query("d2_undersample", RANKED_LABELS + "SELECT doc_id, quality FROM r, m WHERE rn <= least")
def undersample(spark, sf):
    return S.undersample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "d3_oversample",
    RANKED_LABELS
    + """
, k AS (SELECT DISTINCT quality, n, most - n AS deficit FROM r, m)
, d AS (SELECT quality, n, i FROM (SELECT quality, n, unnest(generate_series(1, deficit)) AS i FROM k WHERE deficit > 0))
SELECT doc_id, quality, CAST(0 AS BIGINT) AS draw FROM r
UNION ALL
SELECT r.doc_id, r.quality, d.i FROM d JOIN r ON r.quality = d.quality
 AND r.rn = ('0x' || substr(md5('42|' || d.quality || '|' || d.i), 1, 15))::BIGINT % d.n + 1""",
)
def oversample(spark, sf):
    return S.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "d4_stratified_kfold",
    """
SELECT o_orderkey, o_orderstatus, CAST(rep AS INT) AS repeat, CAST((row_number() OVER (
   PARTITION BY o_orderstatus, rep ORDER BY md5('42|' || rep || '|' || o_orderkey), o_orderkey) - 1) % 5 AS INT) AS fold
FROM orders, (VALUES (0), (1)) v(rep)""",
)
def folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_folds(o, "o_orderstatus", "o_orderkey", folds=5, repeats=2)


@query(
    "d5_shuffle_rows",
    """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS position FROM orders""",
)
def shuffle(spark, sf):
    return S.shuffle_rows(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "d6_balance_deficit",
    """
WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n, max(n) OVER () - n AS deficit, max(n) OVER () = min(n) OVER () AS is_balanced FROM n""",
)
def deficit(spark, sf):
    return S.balance_deficit(table(spark, sf, "labels"), "quality")


@query(
    "d7_balanced_allocation",
    """
WITH b AS (SELECT count(*) AS n, max(quality) AS t FROM labels), m AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem)
SELECT DISTINCT CAST(quality AS VARCHAR) AS class_value,
       CASE WHEN quality = t THEN n // 2 ELSE n - n // 2 END AS n_rows FROM labels, b
UNION ALL SELECT DISTINCT l_returnflag, n // k FROM lineitem, m""",
)
def allocation(spark, sf):
    two = S.balanced_allocation(table(spark, sf, "labels"), "quality").withColumnRenamed("quality", "class_value")
    many = S.balanced_allocation(table(spark, sf, "lineitem"), "l_returnflag").withColumnRenamed("l_returnflag", "class_value")
    return two.withColumn("class_value", F.col("class_value").cast("string")).unionByName(many)


CUSTOMER = "c_custkey, c_acctbal, c_nationkey"


@query(
    "e1_minmax_scale",
    """
WITH t AS (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1, min(c_nationkey) AS n0, max(c_nationkey) AS n1
           FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, round((c_acctbal - a0) / (a1 - a0), 6) + 0.0 AS c_acctbal,
       round((c_nationkey - n0) / CAST(n1 - n0 AS DOUBLE), 6) + 0.0 AS c_nationkey, 0.0E0 AS constant FROM customer, t""",
)
def minmax(spark, sf):
    d = table(spark, sf, "customer").withColumn("constant", F.lit(7))
    train = d.where("c_mktsegment <> 'BUILDING'")
    out = X.minmax_scale(train, ["c_acctbal", "c_nationkey", "constant"], d)
    return rounded(out.select("c_custkey", "c_acctbal", "c_nationkey", "constant"))


@query(
    "e2_standard_scale",
    """
WITH t AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) + 0.0 AS l_quantity,
       round((l_extendedprice - pm) / ps, 6) + 0.0 AS l_extendedprice FROM lineitem, t""",
)
def standard(spark, sf):
    d = table(spark, sf, "lineitem")
    out = X.standard_scale(d, ["l_quantity", "l_extendedprice"])
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query(
    "e3_assemble_features",
    """
SELECT o_orderkey, [o_totalprice, CAST(o_custkey AS DOUBLE), CASE WHEN o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END] AS features FROM orders""",
)
def assemble(spark, sf):
    from pyspark.ml.functions import vector_to_array

    o = table(spark, sf, "orders").withColumn("done", F.col("o_orderstatus") == "F")
    v = X.assemble_features(o, ["o_totalprice", "o_custkey", "done"])
    return v.select("o_orderkey", vector_to_array("features").alias("features"))


# two columns: the principal axes of a 2x2 covariance in closed form
PCA_SQL = """
WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_samp(l_quantity) AS a,
                  var_samp(l_extendedprice / 1000) AS d, covar_samp(l_quantity, l_extendedprice / 1000) AS b FROM lineitem),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ^ 2 + b * b) AS e1, (a + d) / 2 - sqrt(((a - d) / 2) ^ 2 + b * b) AS e2 FROM s),
v AS (SELECT *, b / sqrt(b * b + (e1 - a) ^ 2) AS vx, (e1 - a) / sqrt(b * b + (e1 - a) ^ 2) AS vy FROM e),
g AS (SELECT mx, my, e1 / (e1 + e2) AS r1, e2 / (e1 + e2) AS r2,
             CASE WHEN (CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END) < 0 THEN -1 ELSE 1 END AS s1,
             CASE WHEN (CASE WHEN abs(vy) >= abs(vx) THEN -vy ELSE vx END) < 0 THEN -1 ELSE 1 END AS s2, vx, vy FROM v)
SELECT l_orderkey, l_linenumber,
       round(s1 * ((l_quantity - mx) * vx + (l_extendedprice / 1000 - my) * vy), 4) + 0.0 AS pc1,
       round(s2 * ((l_quantity - mx) * (-vy) + (l_extendedprice / 1000 - my) * vx), 4) + 0.0 AS pc2,
       round(r1, 4) AS ratio1, round(r2, 4) AS ratio2 FROM lineitem, g"""


@query("e4_pca_2d", PCA_SQL)
def pca(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return rounded(X.pca_2d(d, ["l_quantity", "price"], ["l_orderkey", "l_linenumber"]), 4)
