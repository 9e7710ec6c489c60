"""The mini-batch network: gradients, steps, shards, penalties and early ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import models as M
from tabwright.operators import network as N
from tabwright.queries import load


def rings(spark, n):
    """Two classes that no line parts: inside and outside a circle."""
    x, y = F.rand(1) * 2 - 1, F.rand(2) * 2 - 1
    d = spark.range(n).select(F.col("id").alias("key"), F.array(x, y).alias("v"))
    return d.select("key", "v", (F.col("v")[0] ** 2 + F.col("v")[1] ** 2 < 0.6).cast("int").alias("label")).cache()


def accuracy(net, df):
    rows = df.select("v", "label").collect()
    p = net.probabilities(np.array([r["v"] for r in rows]))
    assert np.allclose(p.sum(axis=1), 1)
    return float((p.argmax(axis=1) == [r["label"] for r in rows]).mean())


def test_gradients_are_the_differences():
    rng = np.random.default_rng(0)
    net = N.Network.start([3, 4, 5, 3], 1)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 3, 7)
    _, g = net.gradient(x, y, 0.7)
    flat = net.flat()
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (net.filled(flat + s).gradient(x, y, 0.7)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_one_shard_equals_plain_adam(spark):
    df = rings(spark, 300)
    o = N.NetworkOptions(hidden=(6,), batch=32, max_epochs=27, tolerance=-1.0)
    net = N.fit_network(df, 2, 2, o)
    rows = df.orderBy("key").collect()
    x, y = np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows])
    want = N.Network.start([2, 6, 2], o.seed)
    flat, m, v, t = want.flat(), 0.0, 0.0, 0
    for epoch in range(27):
        order = np.random.default_rng([o.seed, 0, epoch]).permutation(300)
        for at in range(0, 300, 32):
            part = order[at : at + 32]
            _, g = want.filled(flat).gradient(x[part], y[part], o.l2)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
    assert net.epochs == 27 and np.allclose(net.flat(), flat, atol=1e-9)
    again = N.fit_network(df.repartition(7), 2, 2, o)
    assert np.array_equal(again.flat(), net.flat())


def test_many_shards_learn_as_well(spark):
    df = rings(spark, 4000)
    o = N.NetworkOptions(hidden=(20,), rate=0.01, max_epochs=40, batch=50)
    assert accuracy(N.fit_network(df, 2, 2, o), df) > 0.95
    net = N.fit_network(df, 2, 2, o, shard_rows=1200)
    assert accuracy(net, df) > 0.95 and net.losses[-1] < net.losses[0] / 2


def test_penalty_rate_and_early_stopping_matter(spark):
    df = rings(spark, 600)
    o = N.NetworkOptions(hidden=(8,), max_epochs=30)
    base = N.fit_network(df, 2, 2, o)
    heavy = N.fit_network(df, 2, 2, N.replace(o, l2=500.0, rate=0.01))
    size = lambda net: sum(float((w * w).sum()) for w in net.weights)
    assert size(heavy) < size(N.fit_network(df, 2, 2, N.replace(o, rate=0.01))) / 2
    assert N.fit_network(df, 2, 2, N.replace(o, rate=0.01)).losses[-1] < base.losses[-1]
    early = N.fit_network(df, 2, 2, N.replace(o, rate=0.02, max_epochs=400, early_stopping=True, patience=5))
    assert early.epochs < 400 and accuracy(early, df) > 0.9


def test_ends_when_the_loss_stays(spark):
    df = spark.createDataFrame([(i, [1.0], i % 2) for i in range(50)], "key bigint, v array<double>, label int")
    net = N.fit_network(df, 1, 2, N.NetworkOptions(hidden=(3,), rate=0.05))
    assert net.epochs < 500
    with pytest.raises(ValueError, match="at least one"):
        N.fit_network(df.where("key < 0"), 1, 2, N.NetworkOptions())


def test_model_surface_saves_and_refuses(spark, tmp_path):
    df = rings(spark, 400).select("key", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), "label")
    model = M.fit_model("neuralnetwork", df, ["a", "b"], "label", "key", {"hidden_layer_sizes": (10, 5), "max_iter": 20, "learning_rate_init": 0.01, "alpha": 1e-3})
    assert [w.shape for w in model.stage.weights] == [(2, 10), (10, 5), (5, 2)]
    model.save(str(tmp_path / "m"), spark)
    back = M.FittedModel.load(str(tmp_path / "m"), spark)
    assert sorted(map(tuple, back.predict(df, "key").collect())) == sorted(map(tuple, model.predict(df, "key").collect()))
    with pytest.raises(ValueError, match="unknown solver"):
        M.fit_model("neuralnetwork", df, ["a", "b"], "label", "key", {"solver": "sgd"})
    assert M.fit_model("neuralnetwork", df, ["a", "b"], "label", "key", {"max_iter": 5}).predict(df, "key").count() == 400


def test_documents_are_told_apart_better_than_by_their_majority(spark):
    rows = load()[0]["f9_neural_network_batches"](spark, "/root/testdata/sf0.01").collect()
    share = max(sum(r["y"] == k for r in rows) for k in {r["y"] for r in rows}) / len(rows)
    right = sum(r["y"] == r["prediction"] for r in rows) / len(rows)
    assert right > share + 0.05, (right, share)
