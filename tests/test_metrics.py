import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.operators import cluster_metrics as K
from tabwright.operators import metrics as M

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def table(spark, label, prediction, score=None):
    score = score or [float(p) for p in prediction]
    rows = [("m", i, y, p, float(s)) for i, (y, p, s) in enumerate(zip(label, prediction, score, strict=True))]
    return spark.createDataFrame(rows, "model string, row_id int, label int, prediction int, score double")


def auc_by_pairs(label, score):
    pos = [s for y, s in zip(label, score, strict=True) if y == 1]
    neg = [s for y, s in zip(label, score, strict=True) if y != 1]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_binary_by_hand(spark):
    r = M.classification_metrics(table(spark, [1, 1, 1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0, 1, 0])).first()
    assert r["accuracy"] == pytest.approx(6 / 8)
    assert r["sensitivity"] == pytest.approx(2 / 3)
    assert r["specificity"] == pytest.approx(4 / 5)
    assert r["ppv"] == pytest.approx(2 / 3)
    assert r["npv"] == pytest.approx(4 / 5)
    assert r["f1"] == pytest.approx(2 / 3)
    pe = (3 * 3 + 5 * 5) / 64
    assert r["kappa"] == pytest.approx((0.75 - pe) / (1 - pe))


def test_undefined_rates(spark):
    r = M.classification_metrics(table(spark, [0, 0, 1], [0, 0, 0])).first()
    assert (r["ppv"], r["sensitivity"], r["f1"]) == (0.0, 0.0, 0.0)
    one = M.classification_metrics(table(spark, [0, 0], [0, 0])).first()
    assert one["kappa"] is None and one["accuracy"] == 1.0


def test_macro_by_hand(spark):
    label, pred = [0, 0, 1, 1, 2, 2], [0, 1, 1, 1, 2, 0]
    r = M.classification_metrics(table(spark, label, pred)).first()
    recall = np.mean([1 / 2, 1, 1 / 2])
    spec = np.mean([3 / 4, 3 / 4, 1])
    assert r["sensitivity"] == pytest.approx(recall)
    assert r["specificity"] == pytest.approx(spec)
    assert r["ppv"] == pytest.approx(np.mean([1 / 2, 2 / 3, 1]))
    assert r["f1"] == pytest.approx(np.mean([1 / 2, 4 / 5, 2 / 3]))


def test_kappa_of_independent_prediction_is_zero(spark):
    label, pred = zip(*itertools.product([0, 1], [0, 1]), strict=True)
    assert M.classification_metrics(table(spark, label, pred)).first()["kappa"] == pytest.approx(0)


@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
@SLOW
def test_auc_equals_pair_share(spark, rows):
    label, score = zip(*rows, strict=True)
    got = M.roc_auc(table(spark, label, label, score)).first()["auc"]
    want = auc_by_pairs(label, score)
    assert got is None if want is None else got == pytest.approx(want)


@given(st.lists(st.tuples(st.integers(0, 1), st.floats(-3, 3)), min_size=2, max_size=40))
@SLOW
def test_auc_ignores_monotone_maps(spark, rows):
    label, score = zip(*rows, strict=True)
    a = M.roc_auc(table(spark, label, label, score)).first()["auc"]
    b = M.roc_auc(table(spark, label, label, [2 * s + 5 for s in score])).first()["auc"]
    # equal up to scores the map rounds together
    assert a is None and b is None or abs(a - b) < 1e-9 or len({2 * s + 5 for s in score}) < len(set(score))


def test_auc_through_value_buckets(spark):
    rng = np.random.default_rng(1)
    label = [int(x) for x in rng.integers(0, 2, 3000)]
    # a third of all rows share one score
    score = [0.5 if i % 3 == 0 else float(rng.random()) for i in range(3000)]
    t = table(spark, label, label, score)
    assert M.roc_auc(t).first()["auc"] == pytest.approx(auc_by_pairs(label, score))
    curve = M.roc_curve(t).orderBy(F.desc_nulls_first("threshold")).collect()
    assert (curve[0]["fpr"], curve[-1]["fpr"], curve[-1]["tpr"]) == (0.0, 1.0, 1.0)
    assert all(a["fpr"] <= b["fpr"] and a["tpr"] <= b["tpr"] for a, b in zip(curve, curve[1:], strict=False))


def test_ovr_needs_every_class(spark):
    df = spark.createDataFrame([("m", 0, [0.5, 0.3, 0.2]), ("m", 1, [0.2, 0.5, 0.3])], "model string, label int, prob array<double>")
    assert M.roc_auc_ovr(df).first()["auc"] is None
    full = df.unionByName(spark.createDataFrame([("m", 2, [0.1, 0.1, 0.8])], df.schema))
    assert M.roc_auc_ovr(full).first()["auc"] == pytest.approx(1.0)


def test_one_fold_has_no_error(spark):
    t = table(spark, [0, 1, 1], [0, 1, 0]).withColumn("repeat", F.lit(0)).withColumn("fold", F.lit(0))
    got = {r["metric"]: (r["value"], r["moe"]) for r in M.cross_validate_predictions(t).collect()}
    assert got["accuracy"] == (pytest.approx(2 / 3), 0.0)


def test_specificity_evaluator(spark):
    t = table(spark, [0, 0, 0, 1], [0, 0, 1, 1])
    assert M.SpecificityEvaluator().evaluate(t) == pytest.approx(2 / 3)
    assert M.SpecificityEvaluator().isLargerBetter()


# clustering -----------------------------------------------------------------
def points(spark, x, cluster):
    rows = [(i, int(k), *[float(v) for v in p]) for i, (p, k) in enumerate(zip(x, cluster, strict=True))]
    cols = ", ".join(f"f{j} double" for j in range(len(x[0])))
    return spark.createDataFrame(rows, f"id int, cluster int, {cols}")


def silhouette_brute(x, k, squared=False):
    x, k = np.asarray(x, float), np.asarray(k)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = d if squared else np.sqrt(d)
    out = []
    for i in range(len(x)):
        own = (k == k[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, k == c].mean() for c in set(k) - {k[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouette_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(2, 1, (25, 3)), np.tile([[5.0, 5.0, 5.0]], (30, 1)), [[9, 9, 9]]])
    k = [0] * 30 + [1] * 25 + [2] * 30 + [3]
    df = points(spark, x, k)
    f = ["f0", "f1", "f2"]
    assert K.silhouette(df, f, block=block).first()[0] == pytest.approx(silhouette_brute(x, k))
    assert K.silhouette_squared(df, f).first()[0] == pytest.approx(silhouette_brute(x, k, True))


def test_one_cluster_has_no_score(spark):
    df = points(spark, [[0.0], [1.0]], [0, 0])
    for m in (K.silhouette, K.silhouette_squared, K.davies_bouldin, K.calinski_harabasz):
        assert m(df, ["f0"]).first()[0] is None


def test_spread_measures_by_hand(spark):
    x, k = [[0.0], [2.0], [10.0], [14.0]], [0, 0, 1, 1]
    df = points(spark, x, k)
    assert K.davies_bouldin(df, ["f0"]).first()[0] == pytest.approx((1 + 2) / 11)
    within, between = 2 * 1 + 2 * 4, 4 * 5.5**2
    assert K.calinski_harabasz(df, ["f0"]).first()[0] == pytest.approx(between / (within / 2))
    tight = points(spark, [[0.0], [0.0], [1.0]], [0, 0, 1])
    assert K.calinski_harabasz(tight, ["f0"]).first()[0] == 1.0


def agree(spark, a, b):
    return K.agreement(spark.createDataFrame(list(zip(a, b, strict=True)), "label int, cluster int")).first()


def test_agreement_edges(spark):
    same = agree(spark, [0, 0, 1, 1], [5, 5, 3, 3])
    assert all(same[c] == pytest.approx(1.0) for c in same.asDict())
    one = agree(spark, [0, 0, 0], [1, 1, 1])
    assert one["adjusted_rand"] == 1.0 and one["normalized_mutual_info"] == 1.0 and one["v_measure"] == 1.0
    apart = agree(spark, [0, 0, 1, 1], [0, 1, 2, 3])
    assert apart["fowlkes_mallows"] == 0.0


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=3, max_size=30))
@SLOW
def test_agreement_is_symmetric(spark, rows):
    a, b = zip(*rows, strict=True)
    x, y = agree(spark, a, b), agree(spark, b, a)
    for c in ("adjusted_rand", "normalized_mutual_info", "v_measure", "fowlkes_mallows"):
        assert x[c] == pytest.approx(y[c], abs=1e-9)


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=200, deadline=None)
def test_assignment_is_optimal(n, m, seed):
    gain = np.random.default_rng(seed).integers(0, 20, (n, m)).astype(float)
    got = K.best_assignment(gain)
    assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    small, big = (gain, m) if n <= m else (gain.T, n)
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(big), len(small)))
    assert sum(gain[i, j] for i, j in got) == best


def test_alignment_keeps_unmatched(spark):
    df = spark.createDataFrame([(0, 7), (0, 7), (1, 8), (1, 8), (1, 9)], "label int, cluster int")
    mapping, out = K.align_clusters(df)
    assert mapping == {7: 0, 8: 1}
    assert sorted(r["aligned"] for r in out.collect()) == [0, 0, 1, 1, 9]


def test_normal_functions(spark):
    from tabwright.operators.synth import normal_cdf, normal_score

    df = spark.createDataFrame([(p,) for p in (0.001, 0.2, 0.5, 0.9, 0.999)], "p double")
    for r in df.select("p", normal_cdf(normal_score(F.col("p"))).alias("q")).collect():
        assert r["q"] == pytest.approx(r["p"], abs=1e-6)
        assert not math.isnan(r["q"])
