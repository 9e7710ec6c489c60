"""Second-order boosting and exact tree attributions against plain versions."""

import itertools
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabwright.operators import boosting as B
from tabwright.operators import explain as E
from tabwright.operators import models as M
from tabwright.operators.trees import Forest, spark_forest
from tabwright.queries import models as Q


def plain_tree(x, g, h, o):
    """Grows one tree on raw values by trying every cut; (function of a row, leaf sums)."""
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    worth = lambda G, H: G * G / (H + o.l2 + 1e-300)

    def best(rows):
        found = None
        for j in range(x.shape[1]):
            for a, b in itertools.pairwise(cuts[j]):
                t = (a + b) / 2
                low = rows & (x[:, j] <= t)
                high = rows & ~low
                G, H = (g[low].sum(), g[high].sum()), (h[low].sum(), h[high].sum())
                if min(low.sum(), high.sum()) < max(o.least_rows, 1) or min(H) < o.least_hessian:
                    continue
                gain = 0.5 * (worth(G[0], H[0]) + worth(G[1], H[1]) - worth(G[0] + G[1], H[0] + H[1])) - o.least_gain
                gain = float(B.tidy(np.array([gain]))[0])
                if gain > 1e-12 and (found is None or gain > found[0]):
                    found = (gain, j, t, low, high)
        return found

    root = {"rows": np.ones(len(x), bool), "depth": 0}
    open_, leaves = [root], 1
    root["best"] = best(root["rows"])
    while open_:
        ready = [n for n in open_ if n["best"] and (o.max_depth is None or n["depth"] < o.max_depth)]
        if not ready or (o.max_leaves is not None and leaves >= o.max_leaves):
            break
        node = max(ready, key=lambda n: n["best"][0])
        open_ = [n for n in open_ if n is not node]
        _, j, t, low, high = node["best"]
        node["cut"] = (j, t)
        node["kids"] = [{"rows": r, "depth": node["depth"] + 1} for r in (low, high)]
        for k in node["kids"]:
            k["best"] = best(k["rows"])
            open_.append(k)
        leaves += 1
    out = np.zeros(len(x))

    def walk(node):
        if "cut" in node:
            for k in node["kids"]:
                walk(k)
        else:
            out[node["rows"]] = -o.rate * g[node["rows"]].sum() / (h[node["rows"]].sum() + o.l2)

    walk(root)
    return out


def plain_booster(x, y, n_classes, o):
    """Margins of the training rows after all rounds."""
    share = np.bincount(y, minlength=n_classes) / len(y)
    if n_classes == 2:
        m = np.full(len(y), math.log(share[1] / share[0]))
        for _ in range(o.rounds):
            p = 1 / (1 + np.exp(-m))
            m = m + plain_tree(x, p - y, p * (1 - p), o)
        return m[:, None]
    m = np.tile(np.log(share), (len(y), 1))
    for _ in range(o.rounds):
        e = np.exp(m - m.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        m = m + np.column_stack([plain_tree(x, p[:, k] - (y == k), o.softmax_hessian * p[:, k] * (1 - p[:, k]), o) for k in range(n_classes)])
    return m


def sample(n, classes, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 3)), 1)
    score = x[:, 0] + 0.7 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.4, n)
    return x, np.clip(np.floor(score + classes / 2), 0, classes - 1).astype(int)


def rows(spark, x, y):
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "key long, label int, v array<double>")


@pytest.mark.parametrize(
    "classes,options",
    [
        (2, B.BoostOptions(rounds=9, max_depth=3)),
        (2, B.BoostOptions(rounds=4, rate=0.1, max_depth=None, max_leaves=5, l2=0.0, least_hessian=1e-3, least_rows=8, max_bins=255)),
        (3, B.BoostOptions(rounds=3, max_depth=2, least_gain=0.1)),
    ],
)
@pytest.mark.parametrize("narrow", [0, 50, 1 << 16])
def test_leaves_equal_a_plain_booster(spark, monkeypatch, classes, options, narrow):
    """By histograms alone, by histograms down to nodes of 50 rows, and with each tree grown in one task."""
    monkeypatch.setattr(B, "NARROW_ROWS", narrow)
    x, y = sample(160, classes)
    b = B.fit_booster(rows(spark, x, y).repartition(3), 3, classes, options)
    assert b.rounds == options.rounds
    np.testing.assert_allclose(b.margins(x), plain_booster(x, y, classes, options), rtol=1e-8, atol=1e-9)


def test_many_partitions_many_values_and_missing_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (3000, 2))
    y = (x[:, 0] + rng.normal(0, 0.2, 3000) > 0).astype(int)
    x[::50, 1] = np.nan
    o = B.BoostOptions(rounds=5, max_depth=3, max_bins=64)
    one = B.fit_booster(rows(spark, x, y), 2, 2, o)
    monkeypatch.setattr(B, "PART_CELLS", 1000)
    monkeypatch.setattr(B, "NARROW_ROWS", 500)
    many = B.fit_booster(rows(spark, x, y), 2, 2, o)
    np.testing.assert_allclose(one.margins(x), many.margins(x), atol=1e-9)
    assert ((one.probabilities(x)[:, 1] > 0.5) == y).mean() > 0.9


def test_held_rows_end_the_growth(spark):
    x, y = sample(400, 2, 3)
    y = np.random.default_rng(4).permutation(y)  # nothing to learn
    b = B.fit_booster(rows(spark, x, y), 3, 2, B.BoostOptions(rounds=60, held_back=0.3, patience=4))
    assert b.rounds < 60 and len(b.losses) == b.rounds + 1
    one = B.fit_booster(rows(spark, x, np.zeros(400, int)), 3, 2, B.BoostOptions(rounds=5))
    assert one.rounds == 0 or (one.probabilities(x)[:, 0] > 0.99).all()


def test_rows_of_a_tree_are_drawn(spark):
    x, y = sample(300, 2, 5)
    o = B.BoostOptions(rounds=6, max_depth=2, subsample=0.5)
    a, b = (B.fit_booster(rows(spark, x, y).repartition(p), 3, 2, o) for p in (1, 4))
    np.testing.assert_allclose(a.margins(x), b.margins(x), atol=1e-9)
    assert a.forest.cover[a.forest.roots].max() < 300


@pytest.mark.parametrize("name", ["xgboost", "histgradientboosting"])
def test_boosters_on_documents_and_their_files(spark, tmp_path, name):
    """Few rounds on real features: every held-out row, a macro F1 floor, the same scores from disk."""
    from tabwright.operators import metrics as H

    tr, te = Q.split(Q.document_rows(spark, "/root/testdata/sf0.01"))
    m = M.fit_model(name, tr, Q.DOC_FEATURES, "y", "row_id", {"n_estimators": 8, "max_iter": 15})
    pred = m.predict(te, "row_id", ["y"]).withColumnRenamed("y", "label").cache()
    assert pred.count() == te.count()
    assert pred.where(F.abs(F.aggregate("prob", F.lit(0.0), lambda a, p: a + p) - 1) > 1e-9).count() == 0
    assert H.classification_metrics(pred, [], macro=True).first()["f1"] > 0.85
    M.save_model(m, str(tmp_path / "m"), spark)
    again = M.load_model(str(tmp_path / "m"), spark).predict(te, "row_id").select("row_id", F.col("prob").alias("p2"))
    assert pred.join(again, "row_id").where("prob <> p2").count() == 0


def subset_value(forest: Forest, x, keep):
    """Score of a row when only the features in ``keep`` are known: other splits weigh both ways by cover."""

    def walk(node):
        f = int(forest.feature[node])
        if f < 0:
            return forest.value[node]
        a, b = int(forest.left[node]), int(forest.right[node])
        if f in keep:
            return walk(a) if x[f] <= forest.threshold[node] else walk(b)
        return (forest.cover[a] * walk(a) + forest.cover[b] * walk(b)) / forest.cover[node]

    return sum(walk(int(r)) for r in forest.roots)


def plain_shapley(value, d):
    out = []
    for i in range(d):
        total = 0.0
        for size in range(d):
            for keep in itertools.combinations([j for j in range(d) if j != i], size):
                weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                total = total + weight * (value({*keep, i}) - value(set(keep)))
        out.append(total)
    return np.array(out)


@pytest.fixture(scope="module")
def five(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(0, 1, (300, 5)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] - 0.5 * x[:, 3] + rng.normal(0, 0.3, 300) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, c double, d double, e double, y int").cache()


@pytest.mark.parametrize("name,params", [("randomforest", {"n_estimators": 6, "max_depth": 9}), ("xgboost", {"n_estimators": 6}), ("gradientboosting", {"n_estimators": 4, "max_depth": 4})])
def test_tree_attributions_equal_brute_force(spark, five, name, params):
    names = list("abcde")
    m = M.fit_model(name, five, names, "y", "row_id", params)
    forest = E.model_forest(m, spark)
    x = np.array([list(r["v"]) for r in m.vectors(five.orderBy("row_id").limit(12), ["row_id"]).orderBy("row_id").collect()])
    got = forest.shapley(x)
    for i in range(len(x)):
        np.testing.assert_allclose(got[i], plain_shapley(lambda keep, i=i: subset_value(forest, x[i], keep), 5), atol=1e-9)
    np.testing.assert_allclose(got.sum(axis=1) + forest.expected, forest.scores(x), atol=1e-9)
    base = x[:4]
    mixed = lambda i, keep, b: np.where([j in keep for j in range(5)], x[i], b)
    against = forest.shapley(x[4:6], base)
    for i in (4, 5):
        want = plain_shapley(lambda keep, i=i: np.mean([forest.scores(mixed(i, keep, b)[None])[0] for b in base], axis=0), 5)
        np.testing.assert_allclose(against[i - 4], want, atol=1e-9)
    rows_ = E.shap_values(m, five, five, "row_id").collect()
    assert len(rows_) == 300 * 5 and {r["class"] for r in rows_} == {1}


def test_flat_forests_score_as_spark_does(spark, five):
    names = list("abcde")
    for name in ("randomforest", "gradientboosting"):
        m = M.fit_model(name, five, names, "y", "row_id", {"n_estimators": 5, "max_depth": 6})
        forest = spark_forest(m.stage, 5, spark)
        p = m.predict(five, "row_id").orderBy("row_id").collect()
        x = np.array([list(r["v"]) for r in m.vectors(five, ["row_id"]).orderBy("row_id").collect()])
        s = forest.scores(x)
        share = s[:, 1] if name == "randomforest" else 1 / (1 + np.exp(-s[:, 0]))
        np.testing.assert_allclose(share, [r["prob"][1] for r in p], atol=1e-9)
    assert spark_forest(M.fit_model("logisticregression", five, names, "y", "row_id").stage, 5, spark) is None


def test_cores_share_the_rows_and_partitions_stay_bounded():
    assert B.partitions(120_000 * 4, 12) == 8  # was one task for all rows
    assert B.partitions(1000, 12) == 1
    assert B.partitions(10 * B.PART_CELLS, 4) == 10


def test_rows_are_read_out_of_sliced_batches():
    bins, margins = np.arange(20, dtype=np.uint8).reshape(10, 2), np.arange(30.0).reshape(10, 3)
    columns = [range(10), [1] * 10, [False] * 10, [x.tobytes() for x in bins], [x.tobytes() for x in margins]]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["key", "label", "held", "bins", "margins"])
    *_, b, m = B.rows_of(batch.slice(3, 4), 2, 3)
    assert np.array_equal(b, bins[3:7]) and np.array_equal(m, margins[3:7])


def test_rows_walk_to_leaves_of_uneven_depth():
    tree = tuple(np.array(x) for x in ([0, -1, 1, -1, -1], [4, 0, 2, 0, 0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1]))
    bins = np.array([[4, 9], [5, 2], [5, 3], [0, 0]], np.uint8)
    assert B.walk(tree, bins).tolist() == [1, 3, 4, 1]
    assert B.walk(tuple(np.array(x) for x in ([-1], [0], [-1], [-1])), bins).tolist() == [0] * 4


def grid_forest(rng, trees=6, features=3, steps=5, outputs=2, depth=5):
    """Trees whose thresholds lie on a small grid, as binned trees have them."""
    roots, feature, threshold, left, right, value, cover = [], [], [], [], [], [], []

    def grow(depth, rows):
        at = len(feature)
        for column, start in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, np.zeros(outputs)), (cover, rows)):
            column.append(start)
        if not depth or rows < 2:
            value[at] = rng.normal(size=outputs)
            return at
        feature[at], threshold[at] = int(rng.integers(features)), float(rng.integers(steps))
        kept = float(rng.integers(1, int(rows)))
        left[at] = grow(depth - 1, kept)
        right[at] = grow(depth - 1, rows - kept)
        return at

    for _ in range(trees):
        roots.append(grow(depth, 200.0))
    return Forest(
        np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right),
        np.vstack(value), np.array(cover, float), features + 1,
    )


def test_cell_tables_equal_the_leaf_by_leaf_attributions():
    rng = np.random.default_rng(5)
    forest = grid_forest(rng)
    x = np.hstack([rng.integers(-1, 6, (400, 3)) + rng.choice([0.0, 0.5], (400, 3)), rng.normal(size=(400, 1))])
    x[::7, 1] = np.nan
    cells = forest.cells
    np.testing.assert_allclose(cells.shapley(x), forest.shapley(x), atol=1e-12)
    np.testing.assert_allclose(cells.shapley(x).sum(axis=1), forest.scores(x) - forest.expected, atol=1e-12)
    lone = Forest(np.array([0]), np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.ones((1, 2)), np.ones(1), 2)
    assert not lone.cells.shapley(np.zeros((3, 2))).any()


def test_cell_tables_are_left_out_when_they_would_be_large():
    rng = np.random.default_rng(6)
    n = 4000
    split = np.arange(n) * 3
    feature = np.full(3 * n, -1)
    feature[split] = np.arange(n) % 4
    left, right = np.full(3 * n, -1), np.full(3 * n, -1)
    left[split], right[split] = split + 1, split + 2
    stumps = Forest(split, feature, rng.normal(size=3 * n), left, right, np.where(feature < 0, 1.0, 0.0)[:, None], np.where(feature < 0, 1.0, 2.0), 4)
    assert stumps.cells is None


def test_rows_travel_in_packed_blocks(spark, monkeypatch):
    """A pass hands Spark a few blocks, not a row per row; of the written tables only the newest stays."""
    seen = []
    grow = B.grow

    def watched(state, *args):
        seen.append((state.count(), state.inputFiles()))
        return grow(state, *args)

    monkeypatch.setattr(B, "grow", watched)
    monkeypatch.setattr(B, "NARROW_ROWS", 500)
    monkeypatch.setattr(B, "BLOCK_ROWS", 1000)
    x, y = sample(3000, 2, 3)
    one = B.fit_booster(rows(spark, x, y), 3, 2, B.BoostOptions(rounds=3, max_depth=3))
    assert one.rounds == 3 and [n <= 8 for n, _ in seen] == [True] * 3
    folders = [{f.rsplit("/", 1)[0].removeprefix("file://") for f in files} for _, files in seen]
    assert [os.path.isdir(f) for (f,) in folders] == [False, False, True]


def test_blocks_give_back_their_rows():
    bins, margins = np.arange(20, dtype=np.uint8).reshape(10, 2), np.arange(30.0).reshape(10, 3)
    part = lambda a, b: B.packed({"key": np.arange(a, b), "label": np.arange(a, b, dtype=np.int32), "held": np.arange(a, b) == 4, "bins": bins[a:b], "margins": margins[a:b]})
    batch = pa.Table.from_batches([part(0, 3), part(3, 7), part(7, 10)]).combine_chunks().to_batches()[0].slice(1, 2)
    key, label, held, b, m = B.rows_of(batch, 2, 3)
    assert key.tolist() == label.tolist() == list(range(3, 10)) and held.tolist() == [False, True, *[False] * 5]
    assert np.array_equal(b, bins[3:]) and np.array_equal(m, margins[3:])
    assert B.rows_of(batch.drop_columns(["key"]), 2, 3)[0] is None
