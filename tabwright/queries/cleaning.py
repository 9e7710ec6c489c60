"""Profiling and cleaning over ``customer`` and ``orders``, with gaps, dashes and yes/no text derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import exprs as X
from tabwright.operators import categories as W
from tabwright.operators import clean as C
from tabwright.operators import profile as P
from tabwright.queries.registry import query, rounded, table

MESSY_COLUMNS = {
    "row_id": "c_custkey",
    "score": "CASE WHEN c_custkey % 11 = 0 THEN '-' WHEN c_custkey % 13 = 0 THEN 'NA' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END",
    "member": "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey < 12 THEN 'Yes' ELSE 'no' END",
    "flag": "CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'false' END",
    "nation": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END",
    "bit": "CAST(c_custkey % 2 AS BIGINT)",
    "balance": "c_acctbal",
    "half": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey + 0.5E0 END",
    "segment": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END",
    "nothing": "CAST(NULL AS DOUBLE)",
}
MESSY_SQL = (
    "WITH messy AS (SELECT "
    + ", ".join(f"{v} AS {k}" for k, v in MESSY_COLUMNS.items())
    + " FROM customer)"
)


def messy(spark, sf):
    return table(spark, sf, "customer").select(
        *[F.expr(v).alias(k) for k, v in MESSY_COLUMNS.items()]
    )


@query(
    "a3_null_tokens",
    MESSY_SQL
    + """
SELECT row_id, CASE WHEN trim(score) IN ('', '-', 'NA') THEN NULL ELSE TRY_CAST(score AS BIGINT) END AS score,
       member, segment FROM messy""",
)
def null_tokens(spark, sf):
    d = P.null_tokens(messy(spark, sf))
    return d.select("row_id", F.col("score").try_cast("bigint").alias("score"), "member", "segment")


TYPE_CASES = """
SELECT '{0}' AS "column",
  CASE WHEN count(*) FILTER (WHERE v IS NOT NULL AND n IS NULL) = 0 AND NOT {1} THEN
    CASE WHEN {2} OR (count(v) < count(*) AND coalesce(bool_and(n % 1 = 0), true))
         THEN CASE WHEN coalesce(bool_and(n IN (0, 1)), true) THEN 'bool' ELSE 'integer' END
         ELSE 'float' END
  WHEN coalesce(bool_and(lower(v) IN ('yes', 'no')), true) OR coalesce(bool_and(lower(v) IN ('true', 'false')), true)
    THEN 'bool'
  ELSE 'string' END AS data_type,
  count(v) < count(*) AS has_missing, count(v) = 0 AS all_null
FROM (SELECT v, TRY_CAST(v AS DOUBLE) AS n FROM (
  SELECT CASE WHEN CAST({0} AS STRING) IN ('-', 'NA', '') THEN NULL ELSE CAST({0} AS STRING) END AS v FROM messy))
"""
# column: (never numeric, integer storage)
TYPE_FACTS = {
    "row_id": ("false", "true"),
    "score": ("false", "coalesce(bool_and(regexp_full_match(v, '[+-]?[0-9]+')), true)"),
    "member": ("true", "false"),
    "flag": ("true", "false"),
    "nation": ("false", "false"),
    "bit": ("false", "true"),
    "balance": ("false", "false"),
    "half": ("false", "false"),
    "segment": ("true", "false"),
    "nothing": ("false", "false"),
}


@query(
    "b1_infer_column_types",
    MESSY_SQL + " UNION ALL ".join(TYPE_CASES.format(k, *v) for k, v in TYPE_FACTS.items()),
)
def infer_types(spark, sf):
    return P.profile_table(messy(spark, sf))


@query(
    "b2_missing_flags",
    MESSY_SQL
    + " UNION ALL ".join(
        f"""\nSELECT '{k}' AS "column", coalesce(bool_or({k} IS NULL"""
        + (" OR score IN ('-', 'NA')" if k == "score" else "")
        + "), false) AS has_missing FROM messy"
        for k in MESSY_COLUMNS
    ),
)
def missing_flags(spark, sf):
    return P.missing_flags(messy(spark, sf))


@query(
    "b3_parse_boolean_text",
    MESSY_SQL
    + """
SELECT row_id, CASE lower(member) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS member,
       CASE lower(flag) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS flag FROM messy""",
)
def boolean_text(spark, sf):
    return messy(spark, sf).select(
        "row_id",
        X.parse_boolean_text(F.col("member")).alias("member"),
        X.parse_boolean_text(F.col("flag")).alias("flag"),
    )


@query(
    "b4_class_values",
    MESSY_SQL
    + """
SELECT CAST(segment AS STRING) AS class_value, min(row_id) AS first_row FROM messy
WHERE segment IS NOT NULL GROUP BY segment""",
)
def class_values(spark, sf):
    return P.class_values(messy(spark, sf), "segment", "row_id")


@query(
    "b5_class_counts",
    MESSY_SQL + " SELECT segment AS class_value, count(*) AS n FROM messy GROUP BY segment",
)
def class_counts(spark, sf):
    return P.class_counts(messy(spark, sf), "segment")


@query(
    "b6_cardinality_ratio",
    MESSY_SQL
    + " UNION ALL ".join(
        f"""
SELECT '{k}' AS "column", count(DISTINCT {k}) + CAST(coalesce(max(CAST({k} IS NULL AS INT)), 0) AS BIGINT) AS n_distinct,
       count(*) AS n_rows,
       round(CAST(count(DISTINCT {k}) + coalesce(max(CAST({k} IS NULL AS INT)), 0) AS DOUBLE) / count(*), 6) AS ratio
FROM messy"""
        for k in ("segment", "member", "score", "balance")
    ),
)
def cardinality(spark, sf):
    return rounded(P.cardinality_ratio(messy(spark, sf), ["segment", "member", "score", "balance"]))


@query(
    "b7_missing_cells",
    MESSY_SQL
    + " UNION ALL ".join(
        f"""\nSELECT row_id, '{k}' AS "column" FROM messy WHERE {k} IS NULL"""
        + (" OR score IN ('-', 'NA')" if k == "score" else "")
        for k in MESSY_COLUMNS
        if k != "row_id"
    ),
)
def missing_cells(spark, sf):
    return P.missing_cells(messy(spark, sf), "row_id")


@query(
    "b8_binary_or_multiclass",
    """
SELECT p_brand, count(DISTINCT p_type) AS n_classes,
       CASE WHEN count(DISTINCT p_type) <= 2 THEN 'binary' ELSE 'multiclass' END AS kind
FROM part GROUP BY p_brand
UNION ALL
SELECT 'sizes', count(DISTINCT p_size > 25), CASE WHEN count(DISTINCT p_size > 25) <= 2 THEN 'binary' ELSE 'multiclass' END
FROM part""",
)
def class_kind(spark, sf):
    p = table(spark, sf, "part")
    two = p.select(F.lit("sizes").alias("p_brand"), (F.col("p_size") > 25).alias("big"))
    return P.class_kind(p, "p_type", ["p_brand"]).unionByName(P.class_kind(two, "big", ["p_brand"]))


SPEC = [
    C.ColumnSpec("score", "float", missing="constant", fill_value="0"),
    C.ColumnSpec("member", "bool", missing="drop"),
    C.ColumnSpec("flag", "bool"),
    C.ColumnSpec("nation", "integer", missing="constant", fill_value="-1"),
    C.ColumnSpec("bit", "bool"),
    C.ColumnSpec("balance", "float"),
    C.ColumnSpec("half", checked=False),
    C.ColumnSpec("segment", "categorical", missing="synthetic"),
    C.ColumnSpec("nothing", checked=False),
    C.ColumnSpec("absent", checked=False),
]


@query(
    "c1_select_columns",
    MESSY_SQL + " SELECT row_id, score, member, flag, nation, bit, balance, segment FROM messy",
)
def select_columns(spark, sf):
    return C.select_columns(messy(spark, sf), SPEC)


@query(
    "c2_spec_order",
    MESSY_SQL
    + """
, best AS (SELECT segment FROM messy WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1),
f AS (SELECT m.*, coalesce(m.segment, b.segment) AS seg FROM messy m, best b WHERE m.member IS NOT NULL)
SELECT row_id, CASE WHEN score IN ('-', 'NA') THEN 0.0E0 ELSE CAST(score AS DOUBLE) END AS score,
       lower(member) = 'yes' AS member, lower(flag) = 'true' AS flag,
       CAST(coalesce(nation, -1) AS BIGINT) AS nation, bit <> 0 AS bit, balance,
       seg = 'AUTOMOBILE' AS "segment_AUTOMOBILE", seg = 'BUILDING' AS "segment_BUILDING",
       seg = 'FURNITURE' AS "segment_FURNITURE", seg = 'HOUSEHOLD' AS "segment_HOUSEHOLD",
       seg = 'MACHINERY' AS "segment_MACHINERY"
FROM f""",
)
def whole_spec(spark, sf):
    """The whole spec applied: categorical columns go first, then the rest in order."""
    return C.apply_spec(P.null_tokens(messy(spark, sf)), SPEC)[0]


@query(
    "c3_fill_constant",
    MESSY_SQL
    + " SELECT row_id, coalesce(nation, -1) AS nation, coalesce(segment, 'UNKNOWN') AS segment FROM messy",
)
def fill_constant(spark, sf):
    d = C.fill_constant(messy(spark, sf), "nation", "-1")
    return C.fill_constant(d, "segment", "UNKNOWN").select("row_id", "nation", "segment")


@query(
    "c4_drop_missing",
    MESSY_SQL + " SELECT row_id, nation FROM messy WHERE nation IS NOT NULL",
)
def drop_missing(spark, sf):
    return C.drop_missing(messy(spark, sf), "nation").select("row_id", "nation")


@query(
    "c5_impute_mode",
    MESSY_SQL
    + """
, best AS (SELECT segment FROM messy WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)
SELECT row_id, coalesce(m.segment, b.segment) AS segment FROM messy m, best b""",
)
def impute_mode(spark, sf):
    return C.impute_mode(messy(spark, sf), "segment").select("row_id", "segment")


@query("c6_impute_iterative")
def impute_iterative(spark, sf):
    d = messy(spark, sf).select("row_id", "nation", "bit", "balance", "half")
    return rounded(C.impute_iterative(d, ["nation", "bit", "balance", "half"], "row_id", only=["nation", "half"]), 4)


# half is nation and a half: where one of them is missing, the other gives it
@query(
    "c6_impute_iterative_determined",
    MESSY_SQL
    + """
SELECT row_id, round(coalesce(nation, half - 0.5E0), 1) AS nation, round(coalesce(half, nation + 0.5E0), 1) AS half FROM messy
WHERE nation IS NOT NULL OR half IS NOT NULL""",
)
def impute_iterative_determined(spark, sf):
    m = messy(spark, sf)
    filled = C.impute_iterative(
        m.select("row_id", "nation", "bit", "balance", "half"), ["nation", "bit", "balance", "half"], "row_id", only=["nation", "half"]
    )
    one = m.where("nation is not null or half is not null").select("row_id")
    return rounded(filled.select("row_id", "nation", "half").join(one, "row_id"), 1)


@query(
    "c7_cast_float",
    MESSY_SQL
    + """
SELECT row_id, CASE WHEN score IN ('-', 'NA') THEN NULL ELSE CAST(score AS DOUBLE) END AS score,
       CAST(bit AS DOUBLE) AS bit FROM messy""",
)
def cast_float(spark, sf):
    d = P.null_tokens(messy(spark, sf))
    return C.cast_float(C.cast_float(d, "score"), "bit").select("row_id", "score", "bit")


@query(
    "c8_cast_bool",
    MESSY_SQL
    + """
SELECT row_id, lower(member) = 'yes' AS member, lower(flag) = 'true' AS flag, bit <> 0 AS bit,
       balance <> 0 AS balance FROM messy WHERE member IS NOT NULL""",
)
def cast_bool(spark, sf):
    d = C.drop_missing(messy(spark, sf), "member")
    for x in ("member", "flag", "bit", "balance"):
        d = C.cast_bool(d, x)
    return d.select("row_id", "member", "flag", "bit", "balance")


@query(
    "c9_cast_integer",
    MESSY_SQL
    + """
SELECT row_id, CAST(CASE WHEN half - floor(half) = 0.5 THEN 2 * round(half / 2) ELSE round(half) END AS BIGINT) AS half,
       CAST(CASE WHEN balance - floor(balance) = 0.5 THEN 2 * round(balance / 2) ELSE round(balance) END AS BIGINT) AS balance
FROM messy WHERE half IS NOT NULL""",
)
def cast_integer(spark, sf):
    d = C.drop_missing(messy(spark, sf), "half")
    return C.cast_integer(C.cast_integer(d, "half"), "balance").select("row_id", "half", "balance")


@query(
    "c10_one_hot",
    """
SELECT p_partkey, p_type = 'ECONOMY' AS "p_type_ECONOMY", p_type = 'LARGE' AS "p_type_LARGE",
       p_type = 'MEDIUM' AS "p_type_MEDIUM", p_type = 'PROMO' AS "p_type_PROMO",
       p_type = 'SMALL' AS "p_type_SMALL", p_type = 'STANDARD' AS "p_type_STANDARD" FROM part""",
)
def one_hot(spark, sf):
    return C.one_hot(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


CODES_SQL = """
WITH counts AS (SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1),
codes AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, md5('0|' || value), value) - 1 AS code FROM counts)
"""


@query(
    "c10_one_hot_sparse",
    CODES_SQL
    + """
SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM codes) AS size, [CAST(code AS INTEGER)] AS indices, [1.0E0] AS "values"
FROM lineitem JOIN codes ON value = CAST(l_orderkey AS VARCHAR)""",
)
def one_hot_sparse(spark, sf):
    """A category for every order: as many as a quarter of the rows."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("order"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
    )
    out = W.one_hot_sparse(lines, "order", "row_id")
    # the struct inside a vector, read through its JSON form
    shape = "struct<v:struct<size:bigint,indices:array<int>,values:array<double>>>"
    inner = F.from_json(F.to_json(F.struct(F.col("order_vector").alias("v"))), shape)["v"]
    return out.select("l_orderkey", "l_linenumber", inner["size"].alias("size"), inner["indices"].alias("indices"), inner["values"].alias("values"))


@query("c11_category_dictionary", CODES_SQL + "SELECT value, n, code FROM codes")
def category_dictionary(spark, sf):
    return W.category_dictionary(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "c11_record_categories",
    MESSY_SQL
    + """
SELECT 'segment' AS "column", list(DISTINCT segment ORDER BY segment) AS categories FROM messy WHERE segment IS NOT NULL""",
)
def record_categories(spark, sf):
    return C.record_categories(messy(spark, sf), "segment")


@query(
    "c12_validate_class",
    """
SELECT c_nationkey AS nation, count(DISTINCT c_mktsegment) AS n_classes,
       count(DISTINCT c_mktsegment) >= 2 AS valid FROM customer GROUP BY c_nationkey""",
)
def validate_class(spark, sf):
    cust = table(spark, sf, "customer")
    C.validate_class(cust, "c_mktsegment")
    kinds = P.class_kind(cust, "c_mktsegment", ["c_nationkey"])
    return kinds.select(
        F.col("c_nationkey").alias("nation"), "n_classes", (F.col("n_classes") >= 2).alias("valid")
    )


@query(
    "c13_use_index_column",
    "SELECT o_orderkey AS row_id, o_totalprice FROM orders",
)
def use_index(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("Index"), "o_totalprice")
    repeated = table(spark, sf, "orders").select(F.col("o_custkey").alias("index"), "o_totalprice")
    assert C.use_index_column(repeated).columns == ["o_totalprice"]
    return C.use_index_column(d)


@query("c14_require_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000")
def require_rows(spark, sf):
    return C.require_rows(table(spark, sf, "orders").where("o_totalprice > 1000").select("o_orderkey"))


STATUS_MAP = {"F": 1, "O": 0, "P": 2}


@query(
    "c15_map_class_labels",
    """
SELECT o_orderkey, o_orderstatus AS status_mapping, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS status,
       o_orderpriority AS status_mapping_feature_0 FROM orders""",
)
def map_labels(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("status_mapping")
    )
    return C.map_class_labels(o, "status", STATUS_MAP)


@query(
    "c16_default_label_map",
    MESSY_SQL
    + """
, m AS (SELECT 'segment' AS source, segment AS class_value, min(row_id) AS f FROM messy WHERE segment IS NOT NULL GROUP BY segment
        UNION ALL SELECT 'member', member, min(row_id) FROM messy WHERE member IS NOT NULL GROUP BY member)
SELECT source, class_value,
       CASE WHEN source = 'member' THEN CAST(lower(class_value) = 'yes' AS BIGINT)
            ELSE row_number() OVER (PARTITION BY source ORDER BY f) - 1 END AS code FROM m""",
)
def default_map(spark, sf):
    d = messy(spark, sf)
    out = None
    for name in ("segment", "member"):
        part = C.default_label_map(P.class_values(d, name, "row_id")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c17_label_dictionary",
    """
SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS code, o_orderstatus AS label FROM orders""",
)
def label_dictionary(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return C.label_dictionary(C.map_class_labels(o, "status", STATUS_MAP), "status")[0]


@query(
    "c18_encode_labels",
    """
SELECT o_orderkey, r.code AS o_orderpriority FROM orders JOIN (
  SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)) r
ON r.p = o_orderpriority""",
)
def encode_labels(spark, sf):
    return C.encode_labels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(
    "c19_drop_incomplete_rows",
    MESSY_SQL
    + """
SELECT row_id, member, nation, half, segment FROM messy
WHERE member IS NOT NULL AND nation IS NOT NULL AND half IS NOT NULL AND segment IS NOT NULL""",
)
def drop_incomplete(spark, sf):
    return C.drop_incomplete_rows(messy(spark, sf).select("row_id", "member", "nation", "half", "segment"))


@query(
    "c20_feature_columns",
    """
SELECT '[l_quantity-l_extendedprice-l_discount-l_tax]' AS column_key, l_returnflag, count(*) AS n,
       round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
       round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_returnflag""",
)
def feature_columns(spark, sf):
    """Class profile over exactly the feature columns, with their key."""
    d = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    names = C.feature_columns(d, "l_returnflag")
    return rounded(
        d.groupBy("l_returnflag").agg(
            F.lit(C.column_key(names)).alias("column_key"),
            F.count(F.lit(1)).alias("n"),
            *[F.avg(x).alias(x) for x in names],
        ),
        4,
    )


@query(
    "c21_conform_testset",
    """
SELECT s_acctbal AS acctbal, s_nationkey AS nationkey, s_suppkey % 3 AS segment FROM supplier""",
)
def conform(spark, sf):
    test = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("Index"),
        (F.col("s_suppkey") % 3).alias("segment"),
        F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"),
    )
    return C.conform_testset(["acctbal", "nationkey", "segment"], test, "segment")


@query(
    "c22_sanitize_name",
    """
SELECT p_partkey, substr(regexp_replace(replace(regexp_replace(p_name || ' (v' || p_size || '.1)#' || p_brand || '.csv', '\\.[^.]*$', ''), ' ', '_'), '[^a-zA-Z0-9_\\-]', '', 'g'), 1, 100) AS name
FROM part""",
)
def sanitize(spark, sf):
    raw = F.concat("p_name", F.lit(" (v"), F.col("p_size").cast("string"), F.lit(".1)#"), "p_brand", F.lit(".csv"))
    return table(spark, sf, "part").select("p_partkey", X.sanitize_name(raw).alias("name"))


@query(
    "c23_coerce_numeric",
    MESSY_SQL + " SELECT row_id, TRY_CAST(score AS DOUBLE) AS score, TRY_CAST(segment AS DOUBLE) AS segment FROM messy",
)
def coerce_numeric(spark, sf):
    return C.coerce_numeric(messy(spark, sf), ["score", "segment"]).select("row_id", "score", "segment")


OPTIONS_SQL = """
WITH options AS (
  SELECT event_id, event_type AS name,
         CASE event_type WHEN 'click' THEN CASE WHEN value > 20 THEN 'True' ELSE 'False' END
              WHEN 'view' THEN CAST(floor(value) AS BIGINT)::VARCHAR || '.5'
              WHEN 'signup' THEN CAST(user_id AS VARCHAR)
              ELSE substr(md5(CAST(event_id AS VARCHAR)), 1, 3) END AS value
  FROM events)
, t AS (SELECT *, value IN ('True', 'False') AS b, contains(value, '.') OR contains(lower(value), 'e') AS f FROM options
        WHERE name IN ('click', 'view', 'signup', 'error'))
, v AS (SELECT *, CASE WHEN NOT b AND f THEN TRY_CAST(value AS DOUBLE) END AS d,
               CASE WHEN NOT b AND NOT f AND regexp_full_match(value, '[+-]?[0-9]+') THEN TRY_CAST(value AS BIGINT) END AS l FROM t)
SELECT event_id, name, CASE WHEN b THEN 'bool' WHEN d IS NOT NULL THEN 'float' WHEN l IS NOT NULL THEN 'int' ELSE 'text' END AS kind,
       CASE WHEN b THEN value = 'True' END AS bool_value, l AS long_value, d AS double_value,
       CASE WHEN NOT b AND d IS NULL AND l IS NULL THEN value END AS text_value
FROM v"""


@query("c24_coerce_options", OPTIONS_SQL)
def coerce_options(spark, sf):
    e = table(spark, sf, "events")
    value = (
        F.when(F.col("event_type") == "click", F.when(F.col("value") > 20, "True").otherwise("False"))
        .when(F.col("event_type") == "view", F.concat(F.floor("value").cast("string"), F.lit(".5")))
        .when(F.col("event_type") == "signup", F.col("user_id").cast("string"))
        .otherwise(F.substring(F.md5(F.col("event_id").cast("string")), 1, 3))
    )
    options = e.select("event_id", F.col("event_type").alias("name"), value.alias("value"))
    return C.coerce_options(options, ["click", "view", "signup", "error"])


@query(
    "c24_option_lists",
    """
SELECT conv_id, list(role ORDER BY turn) AS "values" FROM conversations GROUP BY conv_id""",
)
def option_lists(spark, sf):
    """Repeated list options of one request flattened in order."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("values"))
    return C.option_lists(rows, ["conv_id"], "turn")


@query(
    "n_scalar_functions",
    """
SELECT p_partkey, lower(p_type) AS low, replace(p_name, ' ', '_') AS dashed, split_part(p_brand, '#', 2) AS brand_no,
       starts_with(p_name, 'red') AS is_red, right(p_name, 10) AS tail,
       regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS price_text,
       round(abs(p_size - 25) * sqrt(p_size) + exp(p_size / 50.0E0) + sign(p_size - 25) + p_size % 7, 6) AS maths,
       concat_ws('-', p_type, p_brand) AS joined,
       CASE WHEN p_size - 25 >= 0 THEN '+' ELSE '' END || CAST(p_size - 25 AS VARCHAR) || '.000' AS signed,
       strftime(TIMESTAMP '2024-01-01' + to_days(p_size), '%Y-%m-%dT%H:%M:%S') AS iso
FROM part""",
)
def scalar_functions(spark, sf):
    d = table(spark, sf, "part")
    size = F.col("p_size")
    return rounded(
        d.select(
            "p_partkey",
            F.lower("p_type").alias("low"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("dashed"),
            F.split("p_brand", "#").getItem(1).alias("brand_no"),
            F.startswith(F.col("p_name"), F.lit("red")).alias("is_red"),
            X.log_tail(F.col("p_name"), 10).alias("tail"),
            X.plain_number_text(F.col("p_retailprice")).alias("price_text"),
            (F.abs(size - 25) * F.sqrt(size) + F.exp(size / 50) + F.signum(size - 25) + size % 7).alias("maths"),
            F.concat_ws("-", "p_type", "p_brand").alias("joined"),
            X.signed_label(size - 25).alias("signed"),
            F.date_format(
                F.timestamp_add("DAY", size, F.lit("2024-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss"
            ).alias("iso"),
        )
    )


@query(
    "n_json_functions",
    """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total,
       CAST(max(length(props)) AS BIGINT) AS longest FROM events GROUP BY event_type""",
)
def json_functions(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p.k").alias("k_total"),
        F.max(F.length("props")).cast("long").alias("longest"),
    )
