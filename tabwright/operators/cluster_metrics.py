"""Measures of a clustering, with and without true labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, safe_ratio
from tabwright.operators.metrics import contingency
from tabwright.operators.neighbours import BLOCK_ROWS, mean_distances

Strs = Sequence[str]


def _distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return total


def _centroids(df: DataFrame, features: Strs, cluster: str) -> DataFrame:
    return df.groupBy(c(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c(x).cast("double")).alias(f"m{i}") for i, x in enumerate(features)],
    )


def cluster_spread(df: DataFrame, features: Strs, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, m0.., spread, within): centroid, mean distance and squared distance to it."""
    cent = _centroids(df, features, cluster)
    m = [F.col(f"m{i}") for i in range(len(features))]
    x = [c(f).cast("double") for f in features]
    d2 = df.select(c(cluster).alias("cluster"), *[v.alias(f"x{i}") for i, v in enumerate(x)]).join(
        cent.drop("n"), "cluster"
    )
    dist = _distance2([F.col(f"x{i}") for i in range(len(features))], m)
    parts = d2.groupBy("cluster").agg(F.avg(F.sqrt(dist)).alias("spread"), F.sum(dist).alias("within"))
    return cent.join(parts, "cluster")


def davies_bouldin(df: DataFrame, features: Strs, cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of max (s_i + s_j) / d_ij; NULL below two clusters."""
    k = len(features)
    point = F.struct(
        F.col("cluster").alias("id"),
        F.col("spread").alias("s"),
        F.array(*[F.col(f"m{i}") for i in range(k)]).alias("m"),
    )
    # one row holding the k centroids; pairs are formed from that array
    all_ = cluster_spread(df, features, cluster).agg(F.collect_list(point).alias("ps"))

    def worst(p: Column) -> Column:
        def ratio(q: Column) -> Column:
            d = F.sqrt(
                F.aggregate(
                    F.zip_with(p["m"], q["m"], lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0),
                    lambda acc, v: acc + v,
                )
            )
            # coinciding centroids: no separation to divide by
            return F.when(p["id"] != q["id"], F.when(d > 0, (p["s"] + q["s"]) / d).otherwise(0.0))

        return F.array_max(F.transform("ps", ratio))

    rows = all_.select(F.size("ps").alias("k"), F.transform("ps", worst).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select(F.when(F.col("k") > 1, total / F.col("k")).alias("davies_bouldin_score"))


def calinski_harabasz(df: DataFrame, features: Strs, cluster: str = "cluster") -> DataFrame:
    """(B/(k-1)) / (W/(n-k)); 1 when W is 0, NULL below two clusters."""
    d = len(features)
    spread = cluster_spread(df, features, cluster)
    n = F.sum("n").cast("double")
    k = F.count(F.lit(1))
    grand = [F.sum(F.col(f"m{i}") * F.col("n")) / n for i in range(d)]
    second = F.lit(0.0)
    for i in range(d):
        second = second + F.sum(F.col(f"m{i}") * F.col(f"m{i}") * F.col("n")) - n * grand[i] * grand[i]
    within = F.sum("within")
    score = F.when(within == 0, 1.0).otherwise(second * (n - k) / (within * (k - 1)))
    return spread.agg(F.when(k > 1, score).alias("calinski_harabasz_score"))


def silhouette(
    df: DataFrame, features: Strs, cluster: str = "cluster", block: int = BLOCK_ROWS
) -> DataFrame:
    """Mean Euclidean silhouette; singletons 0, NULL below two clusters.

    Equal rows of one cluster are merged into one weighted point first, so the
    pairwise part grows with the distinct points only. Those are compared block
    by block; for tables with very many distinct points use
    ``silhouette_squared``, which is linear in the rows.
    """
    rows = df.select(c(cluster).alias("cluster"), F.array(*[c(x).cast("double") for x in features]).alias("v"))
    pts = rows.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("w"))
    terms = mean_distances(pts, "cluster", "w", block)
    return _silhouette_of(terms.withColumn("a", F.try_divide("t_own", F.col("n_own") - 1)))


def _silhouette_of(d: DataFrame) -> DataFrame:
    """Weighted mean of (b-a)/max(a,b) from (a, b, n_own, w)."""
    gap = F.greatest("a", "b")
    one = F.when(F.col("n_own") == 1, 0.0).when(gap == 0, 0.0).otherwise((F.col("b") - F.col("a")) / gap)
    return d.agg(
        F.when(F.count("b") > 0, F.sum(one * F.col("w")) / F.sum("w")).alias("silhouette_score")
    )


def silhouette_squared(df: DataFrame, features: Strs, cluster: str = "cluster") -> DataFrame:
    """Silhouette with squared Euclidean distance, from per-cluster sums: one pass over the rows.

    Σ_j |x - y_j|² = n|x|² - 2 x·Σy + Σ|y|², so no pair is ever formed.
    """
    d = len(features)
    x = [c(f).cast("double") for f in features]
    norm = F.lit(0.0)
    for v in x:
        norm = norm + v * v
    stats = df.groupBy(c(cluster).alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("s"),
        F.sum(norm).alias("q"),
    )
    # k rows of d sums: the size of a model, not of the table
    table = [(r["id"], r["n"], r["s"], r["q"]) for r in stats.collect()]
    if len(table) < 2:
        return df.sparkSession.createDataFrame([(None,)], "silhouette_score double")
    rows = df.select(c(cluster).alias("own"), F.array(*x).alias("v"), norm.alias("nn"))
    names = F.array(*[F.lit(t[0]) for t in table])
    ns = F.array(*[F.lit(float(t[1])) for t in table])
    sums = F.array(*[F.array(*[F.lit(float(z)) for z in t[2]]) for t in table])
    qs = F.array(*[F.lit(float(t[3])) for t in table])
    total = F.transform(
        F.sequence(F.lit(0), F.lit(len(table) - 1)),
        lambda i: F.struct(
            names[i].alias("id"),
            ns[i].alias("n"),
            (
                ns[i] * F.col("nn")
                - 2.0
                * F.aggregate(
                    F.zip_with("v", sums[i], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
                )
                + qs[i]
            ).alias("t"),
        ),
    )
    del d
    out = rows.select("own", total.alias("t")).select(
        F.element_at(F.filter("t", lambda e: e["id"] == F.col("own")), 1).alias("me"),
        F.array_min(
            F.transform(F.filter("t", lambda e: e["id"] != F.col("own")), lambda e: e["t"] / e["n"])
        ).alias("b"),
    )
    return _silhouette_of(
        out.select(
            "b",
            F.col("me.n").alias("n_own"),
            F.when(F.col("me.n") > 1, F.greatest(F.lit(0.0), F.col("me.t")) / (F.col("me.n") - 1)).alias("a"),
            F.lit(1).alias("w"),
        )
    )


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _marginals(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        cells.groupBy("label").agg(F.sum("n").alias("n")),
        cells.groupBy("cluster").agg(F.sum("n").alias("n")),
    )


def _agreement_facts(cells: DataFrame) -> DataFrame:
    """One row of pair counts and entropies from contingency cells."""
    a = F.sum("n").over(Window.partitionBy("label"))
    b = F.sum("n").over(Window.partitionBy("cluster"))
    full = cells.withColumns({"a": a, "b": b})
    # every marginal once: spread it over its own cells in proportion to n
    n = F.col("n").cast("double")
    total = F.sum(n)
    return full.agg(
        total.alias("n"),
        F.sum(_pairs(F.col("n"))).alias("s"),
        F.sum(_pairs(F.col("a")) * n / F.col("a")).alias("pa"),
        F.sum(_pairs(F.col("b")) * n / F.col("b")).alias("pb"),
        F.sum(n * F.ln(n / F.col("a") / F.col("b"))).alias("mi"),
        F.sum(n * F.ln(F.col("a").cast("double"))).alias("ha"),
        F.sum(n * F.ln(F.col("b").cast("double"))).alias("hb"),
    ).select(
        "n",
        "s",
        "pa",
        "pb",
        F.greatest(F.lit(0.0), F.ln("n") + F.col("mi") / F.col("n")).alias("mi"),
        F.greatest(F.lit(0.0), F.ln("n") - F.col("ha") / F.col("n")).alias("ha"),
        F.greatest(F.lit(0.0), F.ln("n") - F.col("hb") / F.col("n")).alias("hb"),
    )


def agreement(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """adjusted_rand, normalized_mutual_info, v_measure, fowlkes_mallows in one row."""
    f = _agreement_facts(contingency(df, label, cluster))
    s, pa, pb, mi, ha, hb = (F.col(x) for x in ("s", "pa", "pb", "mi", "ha", "hb"))
    e = pa * pb / _pairs(F.col("n"))
    den = (pa + pb) / 2 - e
    tiny = F.lit(1e-12)
    hom = F.when(ha <= tiny, 1.0).otherwise(mi / ha)
    com = F.when(hb <= tiny, 1.0).otherwise(mi / hb)
    return f.select(
        F.when(F.abs(den) <= tiny, 1.0).otherwise((s - e) / den).alias("adjusted_rand"),
        F.when((ha <= tiny) & (hb <= tiny), 1.0)
        .otherwise(safe_ratio(mi, (ha + hb) / 2, F.lit(0.0)))
        .alias("normalized_mutual_info"),
        safe_ratio(2 * hom * com, hom + com, F.lit(0.0)).alias("v_measure"),
        F.when(s == 0, 0.0).otherwise(s / F.sqrt(pa * pb)).alias("fowlkes_mallows"),
    )


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one (row, column) pairs of largest total gain.

    Shortest augmenting paths with potentials (Jonker-Volgenant style) on a
    table with one row per class.
    """
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        best, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[col]:
            seen[col] = True
            r = owner[col]
            open_ = np.flatnonzero(~seen[1:]) + 1
            slack = cost[r - 1, open_ - 1] - u[r] - v[open_]
            closer = slack < best[open_]
            best[open_[closer]], back[open_[closer]] = slack[closer], col
            nxt = open_[np.argmin(best[open_])]
            step = best[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            best[open_] -= step
            col = nxt
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def align_clusters(df: DataFrame, label: str = "label", cluster: str = "cluster") -> tuple[dict, DataFrame]:
    """Cluster -> label map with the most matches, and the table with ``aligned`` added.

    Counting runs on Spark; only the class-by-cluster table is solved on the
    driver. A cluster without a label keeps its own id.
    """
    cells = contingency(df, label, cluster).collect()
    labels = sorted({r["label"] for r in cells})
    clusters = sorted({r["cluster"] for r in cells})
    gain = np.zeros((len(labels), len(clusters)))
    for r in cells:
        gain[labels.index(r["label"]), clusters.index(r["cluster"])] = r["n"]
    mapping = {clusters[j]: labels[i] for i, j in best_assignment(gain)}
    pairs = [F.lit(z) for kv in mapping.items() for z in kv]
    found = F.try_element_at(F.create_map(*pairs), c(cluster))
    return mapping, df.withColumn("aligned", F.coalesce(found, c(cluster).cast(df.schema[label].dataType)))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(model, label, n, share, all_noise) from (model, label) rows; noise is label -1."""
    per = labels.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model")
    return per.select(
        "model",
        "label",
        "n",
        (F.col("n") / F.sum("n").over(w)).alias("share"),
        F.min(F.col("label") == -1).over(w).alias("all_noise"),
    )
