import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators import clustering as C
from tabwright.operators import neighbours as N
from tabwright.operators.components import connected_components


def frame(spark, x, label=None):
    rows = [(i, [float(v) for v in p], int(label[i]) if label is not None else 0) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def cloud(n=300, hot=100, d=3, seed=0):
    """A third of the points in one spot, the rest spread out."""
    rng = np.random.default_rng(seed)
    return np.vstack([np.ones((hot, d)), rng.normal(0, 3, (n - hot, d))])


@pytest.mark.parametrize("block", [16, 4096])
@pytest.mark.parametrize("k", [1, 5, 120])
def test_nearest_is_exact_with_a_hot_spot(spark, block, k):
    pts, qs = cloud(), cloud(90, 30, seed=5)
    got = N.nearest(frame(spark, qs), frame(spark, pts, np.arange(len(pts)) % 3), k, payload="label", payload_type="int", block=block)
    found: dict[int, list] = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["point_id"])
        assert r["label"] == r["point_id"] % 3
    d2 = ((qs[:, None] - pts[None]) ** 2).sum(-1)
    for i in range(len(qs)):
        want = sorted(range(len(pts)), key=lambda j: (d2[i, j], j))[:k]
        assert np.allclose(d2[i, found[i]], d2[i, want])
        # ties by point id; rounding may only swap equal distances
        assert found[i] == want or np.allclose(np.sort(d2[i, found[i]]), np.sort(d2[i, want]), rtol=0, atol=1e-12)


def test_too_few_points(spark):
    with pytest.raises(ValueError, match="neighbours"):
        N.nearest(frame(spark, [[0.0]]), frame(spark, [[0.0], [1.0]]), 3)


@pytest.mark.parametrize("block", [16, 4096])
def test_counts_and_components_are_exact(spark, block):
    pts = cloud()
    near = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) <= 0.8
    counts = {r["id"]: r["n"] for r in N.count_within(frame(spark, pts), 0.8, block).collect()}
    assert counts == {i: int(near[i].sum()) for i in range(len(pts))}
    links = N.links_within(frame(spark, pts), 0.8, block)
    # far fewer links than pairs
    assert links.count() < 20 * len(pts)
    comp = {r["id"]: r["component"] for r in connected_components(frame(spark, pts).select("id"), links).collect()}
    label = np.arange(len(pts))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(pts))])
        if (new == label).all():
            break
        label = new
    assert comp == {i: int(label[i]) for i in range(len(pts))}


def test_long_chain_is_one_component(spark):
    n = 200
    nodes = spark.range(n)
    edges = nodes.where(f"id < {n - 1}").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = connected_components(nodes, edges)
    assert out.agg(F.min("component"), F.max("component")).first()[:] == (0, 0)


def test_equal_rows_share_a_cluster(spark):
    rows = [(i, 1.0 if i < 60 else float(i), 0.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    labels = {r["id"]: r["label"] for r in C.density_clusters(df, ["x", "y"], "id", 0.5, 5, 5).collect()}
    assert labels == {i: (0 if i < 60 else -1) for i in range(90)}


def blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.3, (25, 2)), rng.normal(4, 0.3, (25, 2))])
    rows = [(i, float(a), float(b), int(i >= 25)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, truth int")


def pure(labels, truth):
    pairs = {(r["label"], r["truth"]) for r in labels.join(truth, "id").collect()}
    return len(pairs) == 2 and len({a for a, _ in pairs}) == 2


@pytest.mark.parametrize("affinity", ["nearest_neighbors", "rbf"])
def test_spectral_finds_blobs(spark, affinity):
    df = blobs(spark)
    assert pure(C.spectral_clusters(df, ["x", "y"], "id", 2, affinity=affinity, n_neighbors=6), df)


def test_spectral_embedding_against_dense_algebra(spark, monkeypatch):
    """A graph with a small gap and several restarts: the wanted eigenvectors, and an error when rounds run out."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (90, 4))
    pts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    a = np.zeros((90, 90))
    for r in C.neighbour_graph(pts, 6).collect():
        a[r["a"], r["b"]] = r["w"]
    d = a.sum(1)
    m = a / np.sqrt(np.outer(d, d))
    values, vectors = np.linalg.eigh(m)
    got = {r["id"]: r["u"] for r in C.spectral_embedding(pts, 3, n_neighbors=6, blocks=4, tol=1e-6).collect()}
    u = np.array([got[i] for i in range(90)]) * np.sqrt(d)[:, None]
    np.testing.assert_allclose(u.T @ u, np.eye(3), atol=1e-6)
    np.testing.assert_allclose(np.diag(u.T @ m @ u), values[::-1][:3], atol=2e-3)
    assert np.abs(u.T @ vectors[:, ::-1][:, 0]).max() > 0.999
    with pytest.raises(C.NotSettled):
        C.spectral_embedding(pts, 3, n_neighbors=6, blocks=1, rounds=1, tol=1e-12)


def test_kmeans_and_density_find_blobs(spark):
    df = blobs(spark)
    labels, _ = C.kmeans(df, ["x", "y"], "id", 2, n_init=2)
    assert pure(labels, df)
    assert pure(C.density_clusters(df, ["x", "y"], "id", 1.0), df)
    noise = C.density_clusters(df, ["x", "y"], "id", 1e-6)
    assert noise.select("label").distinct().collect()[0][0] == -1
    assert pure(C.hierarchical_density_clusters(df, ["x", "y"], "id", 8), df)


def test_a_block_of_distances_holds_no_second_block():
    import tracemalloc

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(1500, 3)), rng.normal(size=(1600, 3))
    b[:10] = a[:10]
    tracemalloc.start()
    try:
        d = N.distances(a, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * d.nbytes
    assert np.array_equal(d, np.sqrt(((a[:, None] - b[None]) ** 2).cumsum(-1)[..., -1])) and not d[range(10), range(10)].any()
    assert np.array_equal(N.within(a, b, 1.5), d <= 1.5)


def test_far_groups_need_no_iteration(spark):
    """Three chains: within one round of one multiplication only known eigenvectors settle."""
    rows = [(i, [float(i // 3), 1000.0 * (i % 3)]) for i in range(180)]
    pts = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["u"] for r in C.spectral_embedding(pts, 3, n_neighbors=4, rounds=1, blocks=1, tol=1e-9).collect()}
    u = np.array([got[i] for i in range(180)])
    for g in range(3):
        np.testing.assert_allclose(u[g::3], np.tile(u[g], (60, 1)), atol=1e-9)
    assert np.linalg.matrix_rank(u, tol=1e-6) == 3


def test_rows_for_open_cells_come_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(N, "SPREAD_BYTES", 8 * 4 * 50)
    b = pd.DataFrame({"id": range(40), "v": [np.full(4, float(i)) for i in range(40)]})
    ok = np.arange(40 * 30).reshape(40, 30) % 3 > 0
    frames = list(N.per_open_cell(b, ok))
    assert len(frames) > 1 and max(map(len, frames)) <= 50
    whole = pd.concat(frames)
    assert [*zip(whole["id"], whole["cell"])] == [*zip(*np.nonzero(ok))]
    assert all((v == i).all() for i, v in zip(whole["id"], whole["v"]))


def test_far_groups_with_repeated_ids_settle(spark, monkeypatch):
    """Ids may repeat: the known vectors are left aside and the iteration answers as before."""
    taken = []
    known = C._averaged
    monkeypatch.setattr(C, "_averaged", lambda *a: taken.append(1) or known(*a))
    rows = [(i, [float(i // 3 % 4), 1000.0 * (i % 3)]) for i in range(30)] + [(4, [1.0, 1000.0])]
    pts = spark.createDataFrame(rows, "id long, v array<double>")
    try:
        C.spectral_embedding(pts, 3, n_neighbors=4, rounds=1, blocks=1)
    except C.NotSettled:
        pass
    assert not taken


@pytest.mark.parametrize(("block", "groups"), [(16, 2), (16, 90), (64, 90), (4096, 5)])
def test_mean_distances_leave_as_a_row_per_point(spark, block, groups):
    """However many groups and blocks there are; large and small groups, weights, and points without a group."""
    rng = np.random.default_rng(8)
    x, w = rng.normal(0, 1, (200, 2)).round(2), rng.integers(1, 4, 200)
    g = np.where(np.arange(200) % 3 > 0, 0, rng.integers(1, groups, 200))
    rows = [(int(k) if i >= 5 else None, v.tolist(), int(m)) for i, (k, v, m) in enumerate(zip(g, x, w, strict=True))]
    df = spark.createDataFrame(rows, "cluster int, v array<double>, w int")
    got = N.mean_distances(df, "cluster", "w", block)
    g, x, w = g[5:], x[5:], w[5:]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * w
    size = {k: w[g == k].sum() for k in set(g)}
    want = [
        (round(d[i, g == g[i]].sum(), 8), round(min(d[i, g == k].sum() / size[k] for k in size if k != g[i]), 8), int(size[g[i]]), int(w[i]))
        for i in range(len(x))
    ]
    found = got.where("n_own is not null").collect()
    assert sorted((round(r["t_own"], 8), round(r["b"], 8), r["n_own"], r["w"]) for r in found) == sorted(want)
    assert [tuple(r)[:3] for r in got.where("n_own is null").collect()] == [(None, None, None)] * 5


def test_a_small_graph_is_iterated_in_one_task(spark, monkeypatch):
    """The steps are no jobs of their own, and the answer is that of the distributed steps; ids may repeat."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (70, 3)))]
    pts = spark.createDataFrame([*rows, rows[4]], "id long, v array<double>")
    spread_out = C._products
    monkeypatch.setattr(C, "_products", lambda *a: pytest.fail("a job for a step"))
    one = C.spectral_embedding(pts, 2, n_neighbors=6, tol=1e-7).toPandas()
    monkeypatch.setattr(C, "_products", spread_out)
    monkeypatch.setattr(C, "NARROW_EDGES", -1)
    many = C.spectral_embedding(pts, 2, n_neighbors=6, tol=1e-7, blocks=8).toPandas()
    u, v = (np.vstack(x.sort_values("id", kind="stable")["u"].to_numpy()) for x in (one, many))
    assert sorted(one["id"]) == sorted(many["id"]) and len(u) == 71
    # each column up to its sign
    np.testing.assert_allclose(u * np.sign((u * v).sum(axis=0)), v, atol=1e-3)


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_products_only_narrow_a_search(far):
    """Candidates by matrix product hold all nearest, ties included, with distances to the last bit."""
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(far, 1, (400, 12)), 1)
    b = np.vstack([a[:150], a[:60], rng.normal(far, 1, (200, 12))])
    d = N.distances(a, b, squared=True)
    edge = np.sort(d, axis=1)[:, 6]
    found = {(i, j): x for s in N.closest(a, b, 7) for i, j, x in zip(*s, strict=True)}
    assert all(d[p] == x for p, x in found.items())
    assert {p for p, x in found.items() if x <= edge[p[0]]} == {*zip(*np.nonzero(d <= edge[:, None]), strict=True)}


def test_a_search_without_closed_cells_uses_one_cell(spark, monkeypatch):
    """In many columns a query went to every cell with all its numbers."""
    sent = []
    join = N.block_join
    monkeypatch.setattr(N, "block_join", lambda q, *a: sent.append(q.count()) or join(q, *a))
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 30))
    pts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in N.nearest(pts, pts, 4, block=64).collect()}
    d = N.distances(x, x, squared=True)
    assert sent[-1] == 200 and max(sent) == 200
    assert got == {(i, r + 1): int(j) for i in range(200) for r, j in enumerate(np.lexsort((range(200), d[i]))[:4])}


@pytest.mark.parametrize("kind", ["spread", "grid", "one line", "bounded"])
def test_windows_hold_all_nearest(kind):
    rng = np.random.default_rng(6)
    a, b = rng.normal(0, 1, (300, 2)), rng.normal(0.5, 1, (500, 2))
    if kind == "grid":
        a, b = np.round(a, 0), np.round(b, 0)
    if kind == "one line":
        a[:, 0], b[:, 0] = 0.0, 0.0
    d = N.distances(a, b, squared=True)
    edge = np.sort(d, axis=1)[:, 4]
    most = edge * rng.choice([0.5, 1.0, 1.5, np.inf], 300) if kind == "bounded" else np.full(300, np.inf)
    found = {(i, j): x for s in N.closest(a, b, 5, most) for i, j, x in zip(*s, strict=True)}
    assert all(d[p] == x for p, x in found.items())
    assert {p for p, x in found.items() if x <= edge[p[0]]} == {*zip(*np.nonzero(d <= np.minimum(edge, most)[:, None]), strict=True)}


def test_other_cells_are_asked_within_the_distance_found_at_home(spark, monkeypatch):
    """A query used to go to every cell near its pivot's cell."""
    sent = []
    join = N.block_join
    monkeypatch.setattr(N, "block_join", lambda q, *a: sent.append(q.count()) or join(q, *a))
    x = np.random.default_rng(7).uniform(0, 1, (3000, 2))
    pts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["point_id"], r["d2"]) for r in N.nearest(pts, pts, 3).collect()}
    d = N.distances(x, x, squared=True)
    assert sent[0] == 3000 and sum(sent) < 2.5 * 3000  # was about 6 cells a query
    assert got == {(i, r + 1): (int(j), d[i, j]) for i in range(3000) for r, j in enumerate(np.lexsort((range(3000), d[i]))[:3])}
