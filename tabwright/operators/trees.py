"""Decision trees as flat arrays: fast scores, and exact Shapley values along their paths."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations, product
from math import factorial

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import scratch_path

#: numbers in the largest block of a Shapley pass
BLOCK = 1 << 21
#: numbers in all cell tables of a forest; a forest that needs more goes leaf by leaf
CELLS = 1 << 22


@dataclass(frozen=True)
class Paths:
    """Leaves that test equally many features: those features, the interval (low, high] and the share of rows each keeps, the leaf's value."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Cells:
    """Expected outputs of a forest by the cells between its thresholds, for each set of known features.

    ``tables`` has, per set, an axis for each of its features and one for the outputs.
    """

    edges: list[np.ndarray]
    tables: dict[tuple[int, ...], np.ndarray]

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows, features, outputs): the mean gain of a feature over all sets without it, by look-up."""
        d = len(self.edges)
        x = np.where(np.isnan(x), np.inf, x)
        at = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        known = {s: np.broadcast_to(t[tuple(at[j] for j in s)], (len(x), t.shape[-1])) for s, t in self.tables.items()}
        out = np.zeros((len(x), d, self.tables[()].shape[-1]))
        for s, score in known.items():
            if s:
                weight = factorial(len(s) - 1) * factorial(d - len(s)) / factorial(d)
                for j in s:
                    out[:, j] += weight * (score - known[tuple(i for i in s if i != j)])
        return out


@dataclass(frozen=True)
class Forest:
    """Trees whose values add up. A row goes left where its feature is at most the threshold; NaN goes right.

    Nodes of all trees stand one after another; ``left`` and ``right`` are node
    numbers, a leaf has feature -1. ``value`` has a column per output, ``cover``
    the training rows (or their weight) that reach a node.
    """

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    n_features: int

    @property
    def outputs(self) -> int:
        return self.value.shape[1]

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        """Leaf of each row of ``x`` in the tree that starts at ``root``."""
        at = np.full(len(x), root, np.int64)
        rows = np.arange(len(x))
        while len(rows):
            f = self.feature[at[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            here = at[rows]
            at[rows] = np.where(x[rows, f] <= self.threshold[here], self.left[here], self.right[here])
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.outputs))
        for root in self.roots:
            out += self.value[self.leaves(x, int(root))]
        return out

    @cached_property
    def expected(self) -> np.ndarray:
        """Mean output over the training rows, by cover."""
        return sum((p.share.prod(axis=1) @ p.value for p in self.paths), np.zeros(self.outputs))

    @cached_property
    def paths(self) -> list[Paths]:
        """The leaves by the number of features on their way."""
        found: dict[int, list] = {}
        for root in self.roots:
            stack = [(int(root), {})]
            while stack:
                node, tests = stack.pop()
                f = int(self.feature[node])
                if f < 0:
                    found.setdefault(len(tests), []).append((tests, node))
                    continue
                low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
                t = float(self.threshold[node])
                for child, a, b in ((self.left[node], low, min(high, t)), (self.right[node], max(low, t), high)):
                    kept = share * float(self.cover[child]) / float(self.cover[node])
                    if kept > 0:
                        stack.append((int(child), {**tests, f: (a, b, kept)}))
        out = []
        for m, leaves in sorted(found.items()):
            names = np.array([list(t) for t, _ in leaves], np.int64).reshape(len(leaves), m)
            facts = np.array([list(t.values()) for t, _ in leaves], float).reshape(len(leaves), m, 3)
            nodes = np.array([n for _, n in leaves])
            out.append(Paths(names, facts[..., 0], facts[..., 1], facts[..., 2], self.value[nodes]))
        return out

    @property
    def cells(self) -> Cells | None:
        """Tables that answer a row by look-up, if they are small: few features with few thresholds, as in binned trees.

        A leaf adds its value, times the shares of the features that are not known,
        to a box of cells: signed corners and running sums along the axes. The work
        is that of the leaves and of the cells, whatever the number of rows.
        """
        d, tests = self.n_features, self.feature >= 0
        edges = [np.unique(self.threshold[tests & (self.feature == j)]) for j in range(d)]
        size = float(self.outputs)
        for e in edges:
            size *= len(e) + 2.0
        if size > CELLS:
            return None
        n = sum(len(p.feature) for p in self.paths)
        first, end = np.zeros((n, d), np.int64), np.tile([len(e) + 1 for e in edges], (n, 1)).astype(np.int64)
        share, value, a = np.ones((n, d)), np.zeros((n, self.outputs)), 0
        for p in self.paths:
            rows = np.arange(a, a + len(p.feature))
            for k in range(p.feature.shape[1]):
                for j, e in enumerate(edges):
                    here = p.feature[:, k] == j
                    low, high = p.low[here, k], p.high[here, k]
                    first[rows[here], j] = np.where(low > -np.inf, np.searchsorted(e, low) + 1, 0)
                    end[rows[here], j] = np.where(high < np.inf, np.searchsorted(e, high) + 1, len(e) + 1)
                    share[rows[here], j] = p.share[here, k]
            value[rows], a = p.value, a + len(rows)
        end = np.maximum(first, end)  # contrary tests: no cell
        tables = {}
        for s in (s for k in range(d + 1) for s in combinations(range(d), k)):
            weighted = value * share[:, [j for j in range(d) if j not in s]].prod(axis=1, keepdims=True)
            shape = tuple(len(edges[j]) + 2 for j in s)
            sums = np.zeros((int(np.prod(shape, dtype=np.int64)), self.outputs))
            for corner in product((0, 1), repeat=len(s)):
                place = np.zeros(n, np.int64)
                for j, late, width in zip(s, corner, shape, strict=True):
                    place = place * width + (end if late else first)[:, j]
                for k in range(self.outputs):
                    sums[:, k] += (-1) ** sum(corner) * np.bincount(place, weighted[:, k], len(sums))
            table = sums.reshape(*shape, self.outputs)
            for axis in range(len(s)):
                table = table.cumsum(axis=axis)
            tables[s] = table
        return Cells(edges, tables)

    def shapley(self, x: np.ndarray, background: np.ndarray | None = None) -> np.ndarray:
        """Shapley values (rows, features, outputs), exact.

        A feature that is left out sends a row down both ways, weighted by cover;
        with ``background`` rows it takes their values instead, one row after
        another, and the mean is taken. A row's values add up to its score minus
        ``expected`` (or the mean score of the background).

        On a leaf's way each feature j passes the row (o = 1) or not (o = 0) and
        keeps a share z of the rows. The weight of feature i is the integral over
        t in [0, 1] of the product over the others of t o + (1 - t) z, a
        polynomial that Gauss-Legendre points give exactly.
        """
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), self.n_features, self.outputs))
        for p in self.paths:
            m = p.feature.shape[1]
            if not m:
                continue
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            points, weights = (points + 1) / 2, weights / 2
            step = max(1, BLOCK // (m * 256))
            for a in range(0, len(p.feature), step):
                part = Paths(p.feature[a : a + step], p.low[a : a + step], p.high[a : a + step], p.share[a : a + step], p.value[a : a + step])
                rows = max(1, BLOCK // part.feature.size)
                for b in range(0, len(x), rows):
                    out[b : b + rows] += self._along(part, x[b : b + rows], background, points, weights)
        return out

    def _along(self, p: Paths, x: np.ndarray, background: np.ndarray | None, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        inside = lambda rows: (rows[:, p.feature] > p.low) & (rows[:, p.feature] <= p.high)
        o = inside(x).astype(float)
        if background is None:
            gain = self._weighted(o, p.share[None], points, weights)
        else:
            z = inside(np.where(np.isnan(background), np.inf, background)).astype(float)
            gain = sum(self._weighted(o, z[k : k + 1], points, weights) for k in range(len(z))) / len(z)
        order = np.argsort(p.feature, axis=None, kind="stable")
        names = p.feature.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        leaf = order // p.feature.shape[1]
        gain = gain.reshape(len(x), -1)[:, order]
        out = np.zeros((len(x), self.n_features, self.outputs))
        for k in range(self.outputs):
            out[:, names[first], k] = np.add.reduceat(gain * p.value[leaf, k], first, axis=1)
        return out

    @staticmethod
    def _weighted(o: np.ndarray, z: np.ndarray, points: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(o.shape, z.shape))
        for t, w in zip(points, weights, strict=True):
            each = t * o + (1 - t) * z
            whole = each.prod(axis=2, keepdims=True)
            # a feature that neither passes the row nor keeps a share closes the leaf: all its weights are zero
            total += w * np.divide(whole, each, out=np.zeros_like(each), where=each > 0)
        return (o - z) * total


def spark_forest(stage, n_features: int, spark) -> Forest | None:
    """Flat arrays of a fitted Spark forest (class shares) or boosted trees (twice the margin, the log odds); None for other models.

    Read from the model's own saved node table, whose size is the model's.
    """
    boosted = isinstance(stage, GBTClassificationModel)
    if not boosted and not isinstance(stage, RandomForestClassificationModel):
        return None
    path = scratch_path(spark, "trees")
    stage.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    return forest_of_nodes(nodes, list(stage.treeWeights), boosted, n_features)


def forest_of_nodes(nodes: DataFrame, weights: list[float], boosted: bool, n_features: int) -> Forest:
    d = nodes.select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.prediction", "nodeData.impurityStats", "nodeData.rawCount",
        F.col("nodeData.split.featureIndex").alias("f"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("t"),
    ).orderBy("treeID", "id").toPandas()
    trees, first = np.unique(d["treeID"].to_numpy(), return_index=True)
    start = dict(zip(trees.tolist(), first.tolist(), strict=True))
    base = d["treeID"].map(start).to_numpy()
    leaf = d["leftChild"].to_numpy() < 0
    if boosted:
        w = np.array([weights[int(t)] for t in d["treeID"]])
        value = (2.0 * w * d["prediction"].to_numpy())[:, None]
    else:
        stats = np.vstack(d["impurityStats"].to_numpy())
        value = stats / stats.sum(axis=1, keepdims=True) / len(trees)
    return Forest(
        np.asarray(first), np.where(leaf, -1, d["f"].to_numpy()).astype(np.int64), d["t"].to_numpy(float),
        np.where(leaf, -1, base + d["leftChild"].to_numpy()), np.where(leaf, -1, base + d["rightChild"].to_numpy()),
        np.where(leaf[:, None], value, 0.0), d["rawCount"].to_numpy(float), n_features,
    )
