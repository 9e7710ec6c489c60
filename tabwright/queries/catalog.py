"""Catalog and progress questions over ``events``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import catalog as K
from tabwright.queries.registry import query, table
from tabwright.streaming import progress as P

REPORTS_SQL = """
WITH reports AS (SELECT p_partkey AS uuid, p_name || '_' || p_size AS filename, p_type AS status, p_brand AS comments,
                        TIMESTAMP '2024-01-01' + to_days(p_size) AS created_at FROM part)
"""


def reports(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("uuid"),
        F.concat("p_name", F.lit("_"), F.col("p_size").cast("string")).alias("filename"),
        F.col("p_type").alias("status"),
        F.col("p_brand").alias("comments"),
        F.timestamp_add("DAY", F.col("p_size"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
    )


RUNS_SQL = """
WITH runs AS (SELECT event_id AS id, user_id AS report_uuid, ts AS created_at, props AS args,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'cancelled' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state
  FROM events)
"""


def runs(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("report_uuid"),
        F.col("ts").alias("created_at"),
        F.col("props").alias("args"),
        F.when(kind == "click", "queued").when(kind == "view", "running").when(kind == "signup", "cancelled")
        .when(kind == "purchase", "succeeded").otherwise("failed").alias("state"),
    )


@query(
    "m1_catalog_search",
    REPORTS_SQL
    + """
SELECT uuid, filename, status, comments, strftime(created_at, '%Y-%m-%d') AS day FROM reports
WHERE filename ILIKE '%RED%' OR status ILIKE '%RED%' ORDER BY created_at DESC, uuid LIMIT 25 OFFSET 10""",
)
def search(spark, sf):
    page = K.catalog_search(reports(spark, sf), "RED", start=10, length=25)
    return page.select("uuid", "filename", "status", "comments", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query(
    "m2_catalog_counts",
    REPORTS_SQL
    + """
SELECT count(*) AS total, count(*) FILTER (WHERE filename ILIKE '%promo%' OR status ILIKE '%promo%') AS filtered FROM reports""",
)
def counts(spark, sf):
    return K.catalog_counts(reports(spark, sf), "promo")


@query(
    "m3_latest_run",
    RUNS_SQL
    + "SELECT id, report_uuid, state FROM runs QUALIFY row_number() OVER (PARTITION BY report_uuid ORDER BY created_at DESC, id DESC) = 1",
)
def latest(spark, sf):
    return K.latest_run(runs(spark, sf)).select("id", "report_uuid", "state")


@query(
    "m4_previous_run",
    RUNS_SQL
    + "SELECT id, report_uuid, state FROM runs QUALIFY row_number() OVER (PARTITION BY report_uuid ORDER BY created_at DESC, id DESC) = 2",
)
def previous(spark, sf):
    return K.previous_run(runs(spark, sf)).select("id", "report_uuid", "state")


@query(
    "m5_run_history",
    RUNS_SQL
    + """
, art AS (SELECT event_id AS id FROM events WHERE value > 40)
SELECT r.id, report_uuid, state, row_number() OVER (PARTITION BY report_uuid ORDER BY created_at DESC, r.id DESC) = 1 AS is_current,
       a.id IS NOT NULL AS has_artifacts FROM runs r LEFT JOIN art a ON a.id = r.id
QUALIFY a.id IS NOT NULL OR state IN ('succeeded', 'failed')""",
)
def history(spark, sf):
    artifacts = table(spark, sf, "events").where("value > 40").select(F.col("event_id").alias("id"))
    return K.run_history(runs(spark, sf), artifacts).select("id", "report_uuid", "state", "is_current", "has_artifacts")


@query(
    "m6_unique_name",
    REPORTS_SQL
    + """
, used AS (SELECT DISTINCT filename FROM reports)
, base AS (SELECT DISTINCT p_name AS b FROM part)
SELECT b AS base, b || '_copy_1' AS free_name, 'copy' AS kind FROM base
UNION ALL
SELECT b || '_' || s, b || '_' || s || '_1', 'name' FROM (SELECT DISTINCT p_name AS b, p_size AS s FROM part)
UNION ALL
SELECT b, b || '_' || min(k), 'gap' FROM base, generate_series(1, 60) g(k)
WHERE NOT EXISTS (SELECT 1 FROM used WHERE filename = b || '_' || k) GROUP BY b""",
)
def unique_name(spark, sf):
    names = reports(spark, sf).select("filename")
    bases = table(spark, sf, "part").select(F.col("p_name").alias("filename"))
    copy = K.unique_name(names, bases, copy=True).withColumn("kind", F.lit("copy"))
    name = K.unique_name(names, names).withColumn("kind", F.lit("name"))
    gap = K.unique_name(names.unionByName(bases), bases).withColumn("kind", F.lit("gap"))
    return copy.unionByName(name).unionByName(gap)


@query(
    "m7_recent_actions",
    "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def actions(spark, sf):
    e = table(spark, sf, "events")
    return K.recent_actions(e, 50, "ts", "event_id").select("event_id", "user_id", "event_type")


@query(
    "m8_previous_parameters",
    RUNS_SQL
    + """
SELECT report_uuid, id, CAST(json_extract_string(args, '$.k') AS BIGINT) AS k FROM runs
QUALIFY row_number() OVER (PARTITION BY report_uuid ORDER BY created_at DESC, id DESC) = 1""",
)
def parameters(spark, sf):
    return K.previous_parameters(runs(spark, sf), "k bigint")


@query(
    "m9_run_results",
    """
WITH r AS (SELECT user_id AS report_id, strftime(ts, '%Y%m%d') AS run_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT report_id, run_id, event_type, n FROM r WHERE report_id = 7 AND run_id = (SELECT max(run_id) FROM r WHERE report_id = 7)""",
)
def run_results(spark, sf):
    r = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("report_id"), F.date_format("ts", "yyyyMMdd").alias("run_id"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return K.run_results(r, 7)


PROGRESS_SQL = """
WITH u AS (SELECT user_id AS job, ts, event_id AS seq,
    CASE WHEN event_type = 'error' AND value > 30 THEN 'failed' WHEN event_type = 'purchase' AND value > 30 THEN 'succeeded' ELSE 'running' END AS state,
    CAST(floor(value / 20) AS BIGINT) AS completed, CAST(10 AS BIGINT) AS total, CASE WHEN value > 15 THEN 'busy' ELSE 'idle' END AS message,
    CAST(floor(value / 40) AS BIGINT) AS log_length FROM events)
"""


def updates(spark, sf):
    v, kind = F.col("value"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when((kind == "error") & (v > 30), "failed").when((kind == "purchase") & (v > 30), "succeeded").otherwise("running").alias("state"),
        F.floor(v / 20).cast("bigint").alias("completed"),
        F.lit(10).cast("bigint").alias("total"),
        F.when(v > 15, "busy").otherwise("idle").alias("message"),
        F.floor(v / 40).cast("bigint").alias("log_length"),
    )


@query(
    "s1_emit_on_change",
    PROGRESS_SQL
    + """
, e AS (SELECT *, min(CASE WHEN state <> 'running' THEN (ts, seq) END) OVER (PARTITION BY job) AS fin FROM u)
, p AS (SELECT *, lag((completed, total, message, log_length)) OVER (PARTITION BY job ORDER BY ts, seq) AS was FROM e WHERE fin IS NULL OR (ts, seq) <= fin)
SELECT job, seq, state, completed, message FROM p WHERE was IS NULL OR was <> (completed, total, message, log_length) OR state <> 'running'""",
)
def changes(spark, sf):
    return P.emit_on_change(updates(spark, sf)).select("job", "seq", "state", "completed", "message")


@query(
    "s2_latest_progress",
    PROGRESS_SQL
    + "SELECT job, completed, total, message FROM u QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) = 1",
)
def latest_progress(spark, sf):
    return P.latest_progress(updates(spark, sf))


