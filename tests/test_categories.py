"""Wide categories: dictionaries, codes and sparse vectors of columns with very many values."""

from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabwright.operators import categories as W
from tabwright.operators import clean as C

MANY = 200_000


def wide(spark):
    """A third of the rows share one value, a tenth are null, the rest have 200,000 values."""
    i = F.col("row_id")
    value = F.when(i % 3 == 0, "hot").when(i % 10 == 1, None).otherwise(F.concat(F.lit("v"), (i % MANY).cast("string")))
    return spark.range(3 * MANY).select(F.col("id").alias("row_id"), value.alias("kind"))


def test_many_categories_stay_a_table(spark):
    df = wide(spark)
    d = W.category_dictionary(df, "kind").cache()
    rows = [r["kind"] for r in df.where("kind is not null").select("kind").collect()]
    want = Counter(rows)
    got = {r["value"]: (r["n"], r["code"]) for r in d.collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(want)
    by_code = sorted(got.values(), key=lambda x: x[1])
    assert [code for _, code in by_code] == list(range(len(want)))
    assert all(a[0] >= b[0] for a, b in zip(by_code, by_code[1:], strict=False))
    assert got["hot"][1] == 0

    out = W.one_hot_sparse(df, "kind", "row_id", d)
    assert out.columns == ["row_id", "kind_vector"] and out.count() == 3 * MANY
    some = out.join(df, "row_id").where("row_id % 997 = 0").collect()
    for r in some:
        assert r["kind_vector"].size == len(want)
        entries = dict(zip(r["kind_vector"].indices.tolist(), r["kind_vector"].values.tolist(), strict=True))
        assert entries == ({} if r["kind"] is None else {got[r["kind"]][1]: 1.0})
    # one column however many values, and no value in the plan
    plan = out._jdf.queryExecution().toString()
    assert "v199" not in plan and len(plan) < 60_000 and "CartesianProduct" not in plan
    d.unpersist()


def test_codes_of_unknown_null_and_empty_values(spark):
    train = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "row_id bigint, k string")
    d = W.category_dictionary(train, "k")
    codes = {r["value"]: r["code"] for r in d.collect()}
    assert codes["a"] == 0 and sorted(codes) == ["", "a", "b"]
    new = spark.createDataFrame([(1, "b"), (2, "zz"), (3, None), (4, ""), (4, "")], "row_id bigint, k string")
    got = sorted((r["row_id"], r["k_code"]) for r in W.with_codes(new, "k", d, "row_id").where("row_id <> 3 and row_id <> 2").collect())
    assert got == [(1, codes["b"]), (4, codes[""]), (4, codes[""])]
    lost = W.with_codes(new, "k", d, "row_id").where("row_id in (2, 3)").collect()
    assert [r["k_code"] for r in lost] == [None, None]
    empty = W.category_dictionary(train.where("row_id > 9"), "k")
    assert empty.count() == 0
    assert [r["k_vector"].size for r in W.one_hot_sparse(train, "k", "row_id", empty).collect()] == [0] * 5


def test_long_values_are_not_broadcast(spark):
    long = "x" * (W.HOT_CHARS + 1)
    df = spark.createDataFrame([(i, long if i % 2 else "s") for i in range(20)], "row_id bigint, k string")
    got = W.with_codes(df, "k", W.category_dictionary(df, "k"), "row_id")
    assert got.where("k_code is null").count() == 0 and got.select("k", "k_code").distinct().count() == 2


def test_sparse_form_equals_the_flags(spark):
    df = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4], float(i % 4 == 2)) for i in range(80)], "row_id bigint, k string, y double")
    flags = {r["row_id"]: {x[2:] for x in ("k_a", "k_b", "k_c") if r[x]} for r in C.one_hot(df, "k").collect()}
    d = W.category_dictionary(df, "k")
    names = {r["code"]: r["value"] for r in d.collect()}
    sparse = W.one_hot_sparse(df, "k", "row_id", d)
    assert {r["row_id"]: {names[int(i)] for i in r["k_vector"].indices} for r in sparse.collect()} == flags
    model = LogisticRegression(featuresCol="k_vector", labelCol="y").fit(sparse)
    assert model.transform(sparse).where("prediction <> y").count() == 0
