"""Sources and sinks: what is written comes back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.queries.registry import query, rounded, table
from tabwright.session import scratch_path
from tabwright.sources import tables as io

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"

# names with quotes, commas and gaps, as a CSV must carry them
NOTES_SQL = """
SELECT s_suppkey,
       CASE WHEN s_nationkey > 12 THEN s_name || ', "main"' ELSE s_name END AS note,
       CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance,
       s_nationkey > 12 AS is_main
FROM supplier
"""


@query("a1_read_table_csv", CUSTOMER)
def read_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return io.read_table_csv(spark, path)


# every file written as UTF-8 is found so, every other one is not
@query("a2_detect_file_encoding", "SELECT written_as, 0 AS n_wrong FROM (VALUES ('UTF-8'), ('ISO-8859-1')) v(written_as)")
def detect_encoding(spark, sf):
    path = scratch_path(spark, "encodings")
    docs = table(spark, sf, "documents").select("lang", "text")
    for name in ("UTF-8", "ISO-8859-1"):
        docs.write.option("encoding", name).csv(f"{path}/kind={name}")
    found = io.detect_file_encoding(spark, path).where(F.col("path").contains("part-"))
    kind = F.regexp_extract("path", "kind=([^/]+)/", 1)
    right = (kind == "UTF-8") == (F.lower("encoding") == "utf-8")
    return found.groupBy(kind.alias("written_as")).agg(F.count_if(~right).cast("int").alias("n_wrong"))


@query("a4_write_table_csv", NOTES_SQL)
def write_csv(spark, sf):
    s = table(spark, sf, "supplier")
    notes = s.select(
        "s_suppkey",
        F.when(F.col("s_nationkey") > 12, F.concat("s_name", F.lit(', "main"'))).otherwise(F.col("s_name")).alias("note"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"),
        (F.col("s_nationkey") > 12).alias("is_main"),
    )
    path = scratch_path(spark, "notes")
    io.write_table_csv(notes, path, index="s_suppkey")
    return io.read_table_csv(spark, path)


@query(
    "a5_save_load_prepared",
    """
SELECT 'original' AS version, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL
SELECT 'prepared', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT 'fallback', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus <> 'P'
""",
)
def prepared(spark, sf):
    root = scratch_path(spark, "datasets")
    o = table(spark, sf, "orders")
    io.save_original(o, root, "r1")
    io.save_prepared(o.where("o_orderstatus <> 'P'"), root, "r1")
    io.save_prepared(o.where("o_orderstatus <> 'P'"), root, "r2")
    read = {
        "original": io.load_original(spark, root, "r1"),
        "prepared": io.load_prepared(spark, root, "r1"),
        "fallback": io.load_original(spark, root, "r2"),
    }
    out = None
    for version, df in read.items():
        part = df.agg(
            F.lit(version).alias("version"),
            F.count(F.lit(1)).alias("n"),
            F.sum("o_totalprice").alias("total"),
        )
        out = part if out is None else out.unionByName(part)
    return rounded(out, 2)


@query(
    "a6_write_json_doc",
    """
SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price
FROM orders GROUP BY o_orderstatus
""",
)
def json_doc(spark, sf):
    path = scratch_path(spark, "metrics")
    stats = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")
    )
    io.write_json_doc(rounded(stats, 4), path)
    return spark.read.schema("status string, n bigint, mean_price double").json(path)


# a report per kind of event, a run per day; a run's rows hold the users' counts of that day
RUNS_SQL = """
WITH runs AS (
  SELECT event_type AS report_id, strftime(ts, '%Y%m%d') AS run_id, user_id, count(*) AS n_events,
         round(sum(value), 2) AS total
  FROM events GROUP BY 1, 2, 3)
"""


@query(
    "a8_archive_run",
    RUNS_SQL
    + """
, newest AS (SELECT report_id, max(run_id) AS run_id FROM runs GROUP BY 1)
SELECT r.report_id, r.run_id, r.user_id, r.n_events, r.total FROM runs r JOIN newest USING (report_id, run_id)
""",
)
def archive(spark, sf):
    events = table(spark, sf, "events")
    runs = events.groupBy(
        F.col("event_type").alias("report_id"), F.date_format("ts", "yyyyMMdd").alias("run_id"), "user_id"
    ).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    path = scratch_path(spark, "runs")
    # two appends, as runs come in: the second half of the month joins what is there
    early = F.substring("run_id", 7, 2) <= "15"
    for part in (runs.where(early), runs.where(~early)):
        io.append_run(part.repartition("report_id", "run_id"), path)
    back = spark.read.schema("user_id bigint, n_events bigint, total double, report_id string, run_id string").parquet(path)
    return rounded(io.current_run(back).select("report_id", "run_id", "user_id", "n_events", "total"), 2)


@query(
    "a9_duplicate_dataset",
    """
SELECT c_custkey, c_mktsegment AS report_id FROM customer
UNION ALL
SELECT c_custkey, 'BUILDING_copy_1' FROM customer WHERE c_mktsegment = 'BUILDING'
""",
)
def duplicate(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("report_id"))
    return d.unionByName(io.duplicate_dataset(d, "BUILDING", "BUILDING_copy_1"))


ARTIFACTS_SQL = """
WITH reports AS (
  SELECT p_partkey AS report_id, CASE WHEN p_size > 40 THEN '' ELSE p_name || p_size END AS original_filename
  FROM part),
deleted AS (SELECT p_partkey AS report_id FROM part WHERE p_brand < 'Brand#2'),
artifacts AS (
  SELECT p_partkey AS report_id, s.suffix
  FROM part, (VALUES ('original_file'), ('file'), ('results')) s(suffix))
"""


@query(
    "a10_purgeable_artifacts",
    ARTIFACTS_SQL
    + """
SELECT a.report_id, a.suffix FROM artifacts a JOIN deleted USING (report_id)
WHERE NOT (a.suffix = 'original_file' AND EXISTS (
  SELECT 1 FROM reports me JOIN reports r ON r.original_filename = me.original_filename
  WHERE me.report_id = a.report_id AND me.original_filename <> '' AND r.report_id <> me.report_id))
""",
)
def purgeable(spark, sf):
    p = table(spark, sf, "part")
    reports = p.select(
        F.col("p_partkey").alias("report_id"),
        F.when(F.col("p_size") > 40, "").otherwise(F.concat("p_name", F.col("p_size").cast("string"))).alias("original_filename"),
    )
    deleted = p.where("p_brand < 'Brand#2'").select(F.col("p_partkey").alias("report_id"))
    artifacts = p.select(
        F.col("p_partkey").alias("report_id"),
        F.explode(F.array(*[F.lit(x) for x in ("original_file", "file", "results")])).alias("suffix"),
    )
    return io.purgeable_artifacts(artifacts, reports, deleted)
