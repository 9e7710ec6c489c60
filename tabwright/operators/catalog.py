"""Questions over the catalog of reports, runs and actions.

A report may own any share of the rows, so newest rows are found by grouped
maxima, which combine before the shuffle, not by ranking whole groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c

SORTABLE = ("filename", "status", "created_at", "comments")


def _match(search: str) -> Column:
    text = f"%{search}%"
    return F.col("filename").ilike(text) | F.col("status").ilike(text)


def catalog_search(
    reports: DataFrame,
    search: str = "",
    order_by: str = "created_at",
    order_dir: str = "desc",
    start: int = 0,
    length: int = 100,
    key: str = "uuid",
) -> DataFrame:
    """One page of reports whose name or status holds the text; the key breaks ties."""
    found = reports.where(_match(search)) if search else reports
    col = c(order_by if order_by in SORTABLE else "created_at")
    order = col.desc_nulls_last() if order_dir == "desc" else col.asc_nulls_last()
    return found.orderBy(order, c(key)).offset(start).limit(length)


def catalog_counts(reports: DataFrame, search: str = "") -> DataFrame:
    """(total, filtered) in one aggregate."""
    hit = F.count_if(_match(search)) if search else F.count(F.lit(1))
    return reports.agg(F.count(F.lit(1)).alias("total"), hit.alias("filtered"))


def _newest(runs: DataFrame, by: str, ts: str, key: str) -> DataFrame:
    whole = F.struct(*[c(x) for x in runs.columns])
    best = runs.groupBy(c(by)).agg(F.max_by(whole, F.struct(c(ts), c(key))).alias("__r"))
    return best.select("__r.*")


def latest_run(runs: DataFrame, by: str = "report_uuid", ts: str = "created_at", key: str = "id") -> DataFrame:
    """Newest run of each report."""
    return _newest(runs, by, ts, key)


def previous_run(
    runs: DataFrame,
    exclude: DataFrame | None = None,
    by: str = "report_uuid",
    ts: str = "created_at",
    key: str = "id",
) -> DataFrame:
    """Newest run of each report other than a given one (its newest when none is given)."""
    gone = (latest_run(runs, by, ts, key) if exclude is None else exclude).select(c(key))
    return _newest(runs.join(gone, key, "left_anti"), by, ts, key)


def run_history(
    runs: DataFrame,
    artifacts: DataFrame,
    by: str = "report_uuid",
    ts: str = "created_at",
    key: str = "id",
) -> DataFrame:
    """Runs with ``is_current`` and ``has_artifacts``, newest first.

    Runs without artifacts stay only when they succeeded or failed.
    """
    current = latest_run(runs, by, ts, key).select(c(key), F.lit(True).alias("is_current"))
    kept = artifacts.select(c(key)).distinct().withColumn("has_artifacts", F.lit(True))
    out = runs.join(current, key, "left").join(kept, key, "left").withColumns(
        {
            "is_current": F.coalesce("is_current", F.lit(False)),
            "has_artifacts": F.coalesce("has_artifacts", F.lit(False)),
        }
    )
    done = F.col("state").isin("succeeded", "failed")
    return out.where(F.col("has_artifacts") | done).orderBy(c(ts).desc(), c(key).desc())


def unique_name(names: DataFrame, wanted: DataFrame, copy: bool = False, name: str = "filename") -> DataFrame:
    """(base, free_name): the base itself if unused (never for a copy), else the first free suffix.

    Suffixes in use are numbered within their base; the first whose number is
    larger than its place marks the gap.
    """
    mark = "_copy_" if copy else "_"
    taken = names.select(c(name).alias("n")).distinct()
    suffix = F.regexp_extract("n", r"([1-9][0-9]{0,17})$", 1)
    stem = F.expr(f"substring(n, 1, length(n) - length(s) - {len(mark)})")
    split = (
        taken.withColumn("s", suffix)
        .where(F.col("s") != "")
        # every way to cut the digits: "a_12" is base "a" with 12; "a1_2" is base "a1" with 2
        .where(F.expr(f"substring(n, length(n) - length(s) - {len(mark)} + 1, {len(mark)}) = '{mark}'"))
        .select(stem.alias("base"), F.col("s").cast("long").alias("k"))
    )
    bases = wanted.select(c(name).alias("base")).distinct()
    used = split.join(bases, "base", "left_semi")
    # k is free when k-1 is in use (or 0) and k is not: the smallest such k is the first gap
    after = used.select("base", (F.col("k") + 1).alias("k")).unionByName(
        bases.select("base", F.lit(1).cast("long").alias("k"))
    )
    gaps = after.join(used, ["base", "k"], "left_anti").groupBy("base").agg(F.min("k").alias("k"))
    exists = taken.select(F.col("n").alias("base"), F.lit(True).alias("exists"))
    out = bases.join(gaps, "base", "left").join(exists, "base", "left")
    suffixed = F.concat("base", F.lit(mark), F.col("k").cast("string"))
    free = suffixed if copy else F.when(F.col("exists"), suffixed).otherwise(F.col("base"))
    return out.select("base", free.alias("free_name"))


def recent_actions(actions: DataFrame, limit: int = 50, ts: str = "time_performed", key: str = "uuid") -> DataFrame:
    """The latest audit rows."""
    return actions.orderBy(c(ts).desc(), c(key).desc()).limit(limit)


def previous_parameters(
    runs: DataFrame,
    schema: str,
    by: str = "report_uuid",
    ts: str = "created_at",
    key: str = "id",
    args: str = "args",
) -> DataFrame:
    """Arguments of each report's latest run, read from its JSON."""
    newest = latest_run(runs, by, ts, key)
    return newest.select(c(by), c(key), F.from_json(c(args), schema).alias("p")).select(
        c(by), c(key), "p.*"
    )


def run_results(
    results: DataFrame, report_id, run_id=None, by: str = "report_id", run: str = "run_id"
) -> DataFrame:
    """Results of a chosen run, or of a report's newest when none is chosen.

    ``results`` partitioned by report and run reads only that run's files.
    """
    mine = results.where(c(by) == report_id)
    if run_id is None:
        run_id = mine.agg(F.max(c(run))).first()[0]
    return mine.where(c(run) == run_id)


__all__: Sequence[str] = [x for x in dir() if not x.startswith("_")]
