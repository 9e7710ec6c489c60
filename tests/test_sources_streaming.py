import datetime
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import catalog as K
from tabwright.operators import report as R
from tabwright.operators import scoring as SC
from tabwright.queries import load
from tabwright.queries.catalog import updates
from tabwright.session import plan_bytes, shared_dir, write_through
from tabwright.sources import tables as io
from tabwright.streaming import progress as P

QUERIES, _ = load()


def test_bom_tokens_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x,flag,note\n1,2.5,True,a\n2,-,False,NA\n3,NA,,\"q, \"\"r\"\"\"\n".encode("utf-8"))
    df = io.read_table_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "x", "flag", "note"]
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "note": "string"}
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got == [(1, 2.5, True, "a"), (2, None, False, None), (3, None, None, 'q, "r"')]


def test_files_in_different_encodings(spark, tmp_path):
    text = "id,name\n{},Größe café déjà vu naïve\n"
    (tmp_path / "u.csv").write_bytes(text.format(1).encode("utf-8"))
    (tmp_path / "l.csv").write_bytes((text.format(2) * 1 + "3,Mädchen über Straße\n" * 20).encode("cp1252"))
    (tmp_path / "w.csv").write_bytes(text.format(4).encode("utf-16"))
    found = {r["path"].split("/")[-1]: r["encoding"] for r in io.detect_file_encoding(spark, str(tmp_path)).collect()}
    assert found["u.csv"] == "utf-8" and found["w.csv"] == "utf-16"
    df = io.read_csv_any_encoding(spark, str(tmp_path))
    assert df.where("id = 1 or id = 4").select("name").distinct().first()[0] == "Größe café déjà vu naïve"
    assert df.count() == 23


def test_large_files_are_judged_in_pieces(spark, tmp_path, monkeypatch):
    """No piece holds a whole file, every line is looked at, and marks count as before."""
    monkeypatch.setattr(io, "PIECE_BYTES", 4000)
    lines = [b"%d,plain text" % i for i in range(2000)]
    pieces = list(io._judged_pieces(iter([pd.DataFrame({"file": "f", "start": 0, "value": lines})])))
    assert len(pieces) > 5 and sum(int(p["n"][0]) for p in pieces) == sum(len(x) + 1 for x in lines)
    late = "\n".join(["only plain words here"] * 30000 + ["Größe café déjà vu naïve über Straße"] * 20)
    data = {
        "late.csv": late.encode("cp1252"), "utf.csv": late.encode("utf-8"), "mark.csv": b"\xef\xbb\xbf" + late.encode(), "short.csv": b"\xef\xbb\xbf",
        "wide.csv": late.encode("utf-16"), "big.csv": b"\xfe\xff" + late.encode("utf-16-be"), "a b.csv": b"x\n\xff\xfey\n" * 3,
    }
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    found = {r["path"].split("/")[-1]: r["encoding"] for r in io.detect_file_encoding(spark, str(tmp_path)).collect()}
    wanted = {"utf.csv": "utf-8", "mark.csv": "utf-8-sig", "short.csv": "utf-8-sig", "wide.csv": "utf-16", "big.csv": "utf-16"}
    assert set(found) == set(data) and {k: found[k] for k in wanted} == wanted
    assert found["late.csv"] not in ("utf-8", "utf-16") and found["a b.csv"] != "utf-16"


def test_runs_are_kept_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    for run in ("a", "b"):
        io.append_run(spark.createDataFrame([("r1", run, run.upper())], "report_id string, run_id string, v string"), path)
    all_ = spark.read.parquet(path)
    assert all_.count() == 2
    assert io.current_run(all_).first()["v"] == "B"
    one = K.run_results(all_, "r1", "a")
    assert one.first()["v"] == "A"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_id" in plan
    assert K.run_results(all_, "r1").first()["v"] == "B"


def test_original_falls_back_to_prepared(spark, tmp_path):
    root = str(tmp_path)
    io.save_prepared(spark.range(3), root, "x")
    assert io.load_original(spark, root, "x").count() == 3
    io.save_original(spark.range(5), root, "x")
    assert io.load_original(spark, root, "x").count() == 5 and io.load_prepared(spark, root, "x").count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = write_through(spark.range(10), "t")
    assert df.count() == 10 and plan_bytes(df) < 1 << 40


def test_names_fill_the_first_gap(spark):
    names = spark.createDataFrame([("a",), ("a_1",), ("a_3",), ("b_1",), ("a_copy_1",), ("a_10",)], "filename string")
    ask = spark.createDataFrame([("a",), ("b",), ("a_1",)], "filename string")
    assert {r[0]: r[1] for r in K.unique_name(names, ask).collect()} == {"a": "a_2", "b": "b", "a_1": "a_1_1"}
    copies = {r[0]: r[1] for r in K.unique_name(names, ask, copy=True).collect()}
    assert copies == {"a": "a_copy_2", "b": "b_copy_1", "a_1": "a_1_copy_1"}


def test_search_page_and_counts(spark):
    rows = [(i, f"file{i}", "Done" if i % 2 else "Preview", None) for i in range(20)]
    df = spark.createDataFrame(rows, "uuid int, filename string, status string, comments string").withColumn("created_at", F.lit(None).cast("timestamp"))
    page = K.catalog_search(df, "DONE", order_by="filename", order_dir="asc", start=2, length=3)
    assert [r["filename"] for r in page.collect()] == ["file13", "file15", "file17"]
    assert K.catalog_counts(df, "preview").first()[:] == (20, 10)
    assert K.catalog_search(df, order_by="nonsense").count() == 20


def test_previous_run_with_given_exclusion(spark):
    runs = spark.createDataFrame([(1, "r", 10), (2, "r", 20), (3, "r", 30)], "id int, report_uuid string, created_at int")
    assert K.previous_run(runs).first()["id"] == 2
    assert K.previous_run(runs, runs.where("id = 2")).first()["id"] == 3


def rows_of(df):
    return sorted((r["job"], r["seq"], r["state"], r["completed"]) for r in df.select("job", "seq", "state", "completed").collect())


@pytest.mark.parametrize("seconds", [1, 3600, 10**9])
def test_changes_do_not_depend_on_buckets(spark, sf, seconds):
    u = updates(spark, sf)
    assert rows_of(P.emit_on_change(u, bucket_seconds=seconds)) == rows_of(P.emit_on_change(u))


def test_stream_equals_batch(spark, sf, tmp_path):
    u = updates(spark, sf).where("job < 12")
    # files in time order, as a live feed would bring them
    ordered = u.withColumn("part", F.ntile(4).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts")))
    for i in range(1, 5):
        ordered.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = P.stream_changes(stream, idle="30 days").writeStream.outputMode("append").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows_of(spark.table("changes")) == rows_of(P.emit_on_change(u))


def test_silent_jobs_start_anew_and_ended_ones_do_not(spark, tmp_path):
    """With ``idle`` of a minute: job 1 falls silent and is forgotten, job 2 has ended for good."""
    schema = "job bigint, ts timestamp, seq bigint, state string, completed bigint, total bigint, message string, log_length bigint"
    row = lambda job, minute, seq, state="running": (job, datetime.datetime(2026, 1, 1, 0, minute), seq, state, 1, 9, "m", 0)
    files = [[row(1, 0, 0), row(2, 0, 0, "succeeded")], [row(9, 10, 0)], [row(9, 11, 1)], [row(1, 12, 1), row(2, 12, 1)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = P.stream_changes(stream, idle="1 minute").writeStream.outputMode("append").format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["job"], r["seq"]) for r in spark.table("silent").collect()) == [(1, 0), (1, 1), (2, 0), (9, 0)]


UPDATE = "job bigint, ts timestamp, seq bigint, state string, completed bigint, total bigint, message string, log_length bigint"


def update(job, minute, seq, completed, state="running"):
    return (job, datetime.datetime(2026, 1, 1, 0, minute), seq, state, completed, 9, "m", 0)


def feed(spark, tmp_path, files, **options):
    """Changes and late updates of files that arrive one by one."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 if i < len(files) - 1 else 0)
    stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = P.stream_updates(stream, **options)
    sink = P.write_with_late(str(tmp_path / "changes"), str(tmp_path / "late"))
    q = out.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    read = lambda x: spark.read.schema(UPDATE).parquet(str(tmp_path / x))
    return read("changes"), read("late")


def test_late_updates_go_to_a_side_table(spark, tmp_path):
    files = [[update(1, 0, 0, 0), update(1, 5, 2, 2)], [update(1, 3, 1, 1), update(2, 0, 0, 0)], [update(1, 6, 3, 3, "succeeded"), update(2, 4, 1, 1)], [update(2, 2, 9, 7), update(1, 7, 4, 9)]]
    changes, late = feed(spark, tmp_path, files, idle="1 hour")
    assert sorted((r["job"], r["seq"]) for r in changes.collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert sorted((r["job"], r["seq"]) for r in late.collect()) == [(1, 1), (2, 9)]
    assert sorted((r["job"], r["n_late"]) for r in P.late_counts(late).collect()) == [(1, 1), (2, 1)]
    # together with the late rows, the order of the whole feed is the batch answer
    every = [r for f in files for r in f]
    kept = [r for r in every if (r[0], r[2]) not in {(1, 1), (2, 9)}]
    assert rows_of(changes) == rows_of(P.emit_on_change(spark.createDataFrame(kept, UPDATE)))


def test_late_rows_within_the_delay_give_the_batch_answer(spark, tmp_path):
    """Updates out of order by up to four minutes, idle as short as five; ends flush nothing early."""
    files = [
        [update(1, 0, 0, 0), update(1, 4, 2, 1)], [update(1, 2, 1, 1), update(2, 1, 0, 5)], [update(1, 7, 4, 4), update(2, 4, 2, 5)],
        [update(1, 5, 3, 4), update(2, 3, 1, 6), update(1, 9, 5, 4, "failed")], [update(1, 20, 9, 9), update(2, 8, 3, 5)], [update(2, 12, 4, 6, "succeeded")], [update(2, 30, 5, 8)],
    ]
    changes, late = feed(spark, tmp_path, files, idle="5 minutes", delay="4 minutes")
    assert late.count() == 0
    assert rows_of(changes) == rows_of(P.emit_on_change(spark.createDataFrame([r for f in files for r in f], UPDATE)))


def test_held_updates_come_out_when_a_job_goes_silent(spark, tmp_path):
    """Nothing arrives from job 1 for longer than ``idle`` while job 9 goes on: its held update is passed on."""
    files = [[update(1, 0, 0, 0)], [update(9, 0, 0, 0)], [update(9, 1, 1, 1)], [update(9, 2, 2, 2)]]
    changes, _ = feed(spark, tmp_path, files, idle="1 milliseconds", delay="1 hour")
    assert (1, 0) in {(r["job"], r["seq"]) for r in changes.collect()}


def test_latest_progress_as_a_stream(spark, sf, tmp_path):
    u = updates(spark, sf)
    u.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(u.schema).parquet(str(tmp_path / "in"))
    q = P.latest_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, P.latest_progress(u).collect()))


def test_report_formats(spark):
    long = spark.createDataFrame([("m", "test_auc", 0.12345), ("m", "n_test", 7.0), ("m", "test_acc", None)], "model string, metric string, value double")
    cv = spark.createDataFrame([("m", "auc", 0.98765, 0.01234), ("m", "f1", None, None)], "model string, metric string, value double, moe double")
    r = R.results_report(long, cv, "[a-b]", ["test_auc", "test_acc", "n_test", "cvt_auc", "cvt_f1score"]).first()
    assert r[:] == ("m", "[a-b]", "0.123", "N/A", "7", "0.988 ± 0.012", "N/A")
    back = R.parse_mean_error(spark.createDataFrame([r]), ["cvt_auc", "cvt_f1score"]).first()
    assert (back["cvt_auc"], back["cvt_auc_err"], back["cvt_f1score"]) == (0.988, 0.012, 0.0)


def test_heatmap_drops_absent_auc_and_turns_davies(spark):
    df = spark.createDataFrame([("a", None, 0.5), ("b", None, 0.7)], "model string, test_auc double, test_acc double")
    assert [r["metric"] for r in R.metric_heatmap(df, ["test_auc", "test_acc"], ["a", "b"]).collect()] == ["test_acc"]
    u = spark.createDataFrame([("a", 1.0, 3.0), ("b", 1.0, 4.0)], "model string, silhouette_score double, davies_bouldin_score double")
    out = {r["metric"]: (r["a"], r["b"]) for r in R.metric_heatmap(u, u.columns[1:], ["a", "b"], False).collect()}
    assert out == {"silhouette_score": (0.0, 0.0), "davies_bouldin_score": (1.0, 0.0)}
    best = {(r["metric"], r["model"]) for r in R.best_per_metric(u, u.columns[1:]).collect()}
    assert best == {("silhouette_score", "a"), ("silhouette_score", "b"), ("davies_bouldin_score", "a")}


def test_retest_without_rows(spark):
    with pytest.raises(ValueError, match="Failed to retrieve testset"):
        SC.retest(spark, {}, None, "y")


# plans ----------------------------------------------------------------------
MAY_USE_PYTHON = {"a2", "c6", "f8", "f11", "f12", "f13", "g3", "g4", "h16", "k1", "k3"}
LIGHT = [
    "a3_null_tokens", "b1_infer_column_types", "b6_cardinality_ratio", "c2_spec_order", "c10_one_hot", "c18_encode_labels",
    "d1_stratified_split", "d3_oversample", "d4_stratified_kfold", "d5_shuffle_rows", "e1_minmax_scale", "h1_confusion_matrix",
    "h9_roc_curve", "h10_roc_auc", "h12_cross_validate", "h14_train_test_metrics", "h16_silhouette_squared", "h17_davies_bouldin",
    "h18_calinski_harabasz", "h19_adjusted_rand", "i1_shap_linear", "i4_shap_top_features", "j1_results_report", "l6_quality_report",
    "m3_latest_run", "m4_previous_run", "m5_run_history", "m6_unique_name", "s1_emit_on_change", "s2_latest_progress",
    "a10_purgeable_artifacts",
]


@pytest.mark.parametrize("name", LIGHT)
def test_plan_has_no_pairs_and_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan, f"{bad} in {name}"


def test_scan_reads_only_what_is_asked(spark, sf):
    plan = QUERIES["h1_confusion_matrix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "ReadSchema" in x]
    assert scans and all("l_extendedprice" not in x and "l_shipdate" not in x for x in scans)
    one = QUERIES["m9_run_results"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in one
