import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabwright.operators import clean as C
from tabwright.operators import profile as P
from tabwright.plans.options import TrainingOptions


def types(df):
    return {p.column: p.data_type for p in P.infer_column_types(df)}


def test_types_of_text_columns(spark):
    rows = [("1", "1.0", "1", "yes", "TRUE", "a", "-", "1d"), ("0", "2.0", None, "No", "false", "b", "3", "2d")]
    df = spark.createDataFrame(rows, "bit string, dec string, gap string, yn string, tf string, s string, dash string, code string")
    assert types(df) == {
        "bit": "bool", "dec": "float", "gap": "bool", "yn": "bool", "tf": "bool", "s": "string",
        "dash": "integer", "code": "string",
    }


def test_types_of_typed_columns(spark):
    rows = [(1.0, 2.0, 5, None, True, None), (2.0, None, 6, 1.0, False, None)]
    df = spark.createDataFrame(rows, "whole double, gap double, n long, bit double, b boolean, none double")
    got = {p.column: p for p in P.infer_column_types(df)}
    assert got["whole"].data_type == "float" and not got["whole"].has_missing
    assert got["gap"].data_type == "integer" and got["gap"].has_missing
    assert got["n"].data_type == "integer"
    assert got["bit"].data_type == "bool"
    assert got["b"].data_type == "bool"
    assert got["none"].data_type == "bool" and got["none"].all_null


def test_mixed_yes_true_is_text(spark):
    assert types(spark.createDataFrame([("yes",), ("true",)], "v string")) == {"v": "string"}


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,)], "v double")
    assert [r[0] for r in C.cast_integer(df, "v").collect()] == [0, 2, 2, 0, 2]


@pytest.mark.parametrize("cast", [C.cast_bool, C.cast_integer])
def test_null_cannot_be_cast(spark, cast):
    with pytest.raises(PySparkException, match="Cannot convert column v"):
        cast(spark.createDataFrame([(1.0,), (None,)], "v double"), "v").collect()


def test_bad_float_names_column(spark):
    with pytest.raises(PySparkException, match="Cannot convert column v to type float"):
        C.cast_float(spark.createDataFrame([("1",), ("x",)], "v string"), "v").collect()


def test_fill_value_must_fit(spark):
    with pytest.raises(C.ColumnChangeError, match="Cannot fill column v with value x"):
        C.fill_constant(spark.createDataFrame([(1.0,)], "v double"), "v", "x")


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert sorted(r[0] for r in C.impute_mode(df, "v").collect()) == ["a", "a", "a", "b", "b"]


def test_one_hot_gate_and_nulls(spark):
    rows = [(i, "xy"[i % 2] if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v string")
    out = C.one_hot(df, "v")
    assert out.columns == ["id", "v_x", "v_y"]
    assert out.where("id = 0").first()[1:] == (False, False)
    with pytest.raises(C.ColumnChangeError, match="too many categories"):
        C.one_hot(df.limit(10), "v")


def test_checked_column_must_exist(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(C.ColumnChangeError, match="Column z cannot be included"):
        C.select_columns(df, [C.ColumnSpec("z")])
    assert C.select_columns(df, [C.ColumnSpec("z", checked=False), C.ColumnSpec("b", checked=False)]).columns == ["a"]


def test_single_class_is_refused(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "a int, y int")
    with pytest.raises(C.ColumnChangeError, match="more than one class"):
        C.apply_spec(df, [C.ColumnSpec("y", "integer", is_class=True)])


def test_all_rows_dropped_is_refused(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    with pytest.raises(C.ColumnChangeError, match="All rows dropped"):
        C.apply_spec(df, [C.ColumnSpec("a", "float", missing="drop")])


def test_mapping_moves_older_mapping(spark):
    df = spark.createDataFrame([(1.0, "p", "q"), (2.0, "r", "s")], "y double, y_mapping string, y_mapping_feature_0 string")
    out = C.map_class_labels(df, "y", {"1": 1, "2": 0})
    assert set(out.columns) == {"y", "y_mapping", "y_mapping_feature_0", "y_mapping_feature_1"}
    assert sorted((r["y_mapping"], r["y"]) for r in out.collect()) == [("1", 1), ("2", 0)]


def test_default_map_yes_no(spark):
    v = spark.createDataFrame([("Yes", 5), ("No", 1)], "class_value string, first_row long")
    assert {r[0]: r[1] for r in C.default_label_map(v).collect()} == {"Yes": 1, "No": 0}


def test_unseen_label_is_an_error(spark):
    train = spark.createDataFrame([("a",), ("b",)], "y string")
    test = spark.createDataFrame([("c",)], "y string")
    with pytest.raises(PySparkException, match="label not seen in training: c"):
        C.encode_labels(test, "y", C.label_codes(train, "y")).collect()


def test_conform_reports_differences(spark):
    test = spark.createDataFrame([(1, 2, 3)], "index int, b int, z int")
    with pytest.raises(C.ColumnChangeError, match="missing columns: a; .*unexpected columns: z"):
        C.conform_testset(["a", "b"], test)


def test_index_column_only_when_unique(spark):
    good = spark.createDataFrame([(3, 1.0), (4, 2.0)], "Index int, v double")
    assert C.use_index_column(good).columns == ["row_id", "v"]
    bad = spark.createDataFrame([(3, 1.0), (3, 2.0)], "index int, v double")
    assert C.use_index_column(bad).columns == ["v"]


def test_options_from_rows(spark):
    rows = [("test_size", "0.3"), ("folds", "4"), ("parameter_tune", "False"), ("goal", "accuracy"), ("junk", "1")]
    df = spark.createDataFrame(rows, "name string, value string")
    typed = C.coerce_options(df, ["test_size", "folds", "parameter_tune", "goal"]).collect()
    values = {
        r["name"]: next(x for x in (r["bool_value"], r["long_value"], r["double_value"], r["text_value"]) if x is not None)
        for r in typed
    }
    assert values == {"test_size": 0.3, "folds": 4, "parameter_tune": False, "goal": "accuracy"}
    opts = TrainingOptions.from_rows({**values, "train_group": ["kmeans"]})
    assert opts.test_size == 0.3 and opts.train_group == ("kmeans",) and opts.folds == 4


def test_cells_and_flags(spark):
    df = spark.createDataFrame([(1, None, "-"), (2, float("nan"), "x")], "id int, a double, b string")
    cells = {(r["id"], r["column"]) for r in P.missing_cells(df, "id").collect()}
    assert cells == {(1, "a"), (1, "b"), (2, "a")}
    flags = {r["column"]: r["has_missing"] for r in P.missing_flags(df).collect()}
    assert flags == {"id": False, "a": True, "b": True}


def test_class_values_need_column(spark):
    with pytest.raises(ValueError, match="not found"):
        P.class_values(spark.range(1), "y", "id")


def test_spec_order_puts_categories_first():
    s = [C.ColumnSpec("a", "float"), C.ColumnSpec("b", "categorical"), C.ColumnSpec("c", "bool")]
    assert [x.column for x in C.spec_order(s)] == ["b", "a", "c"]


def test_whole_spec_records_categories(spark):
    rows = [(i, "pq"[i % 2], i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id int, k string, y boolean")
    out, spec = C.apply_spec(df, [C.ColumnSpec("y", "bool", is_class=True), C.ColumnSpec("k", "categorical")])
    assert set(out.columns) == {"row_id", "y", "k_p", "k_q"}
    assert next(s for s in spec if s.column == "k").categories == ("p", "q")
    assert out.agg(F.count_if("k_p")).first()[0] == 20
