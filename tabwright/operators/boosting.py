"""Second-order gradient boosting over histograms, one booster for any number of classes.

Features are cut into bins once. A round grows a tree for each class output, and
one job a level sums gradients, Hessians and rows per (tree, node, feature, bin):
each task folds its rows into histograms, and only those are shuffled, by (tree,
node, feature). The reducers return the best split of a feature, so the driver
sees a few numbers per node and feature, whatever the number of rows. A node of
at most ``NARROW_ROWS`` rows needs no further jobs: its rows meet in one task,
which grows everything below it by the same rule.

Rows with their bins and their scores so far lie in the shared folder, packed in
blocks of ``BLOCK_ROWS``: Spark hands on a few large values and no single rows. A
task adds the trees grown since they were written, so a lost executor costs its
tasks and nothing else; every ``REFRESH`` rounds, or every round where a round
reads its rows several times, they are written anew and the old ones dropped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.operators.trees import Forest
from tabwright.session import scratch_path

REFRESH = 8
#: rows of a packed block, and blocks handed to a task at a time
BLOCK_ROWS = 1 << 16
BATCH_BLOCKS = 16
#: a node of at most so many rows is grown to its end by one task
NARROW_ROWS = 1 << 18
#: most cells (rows x features) of a partition; fewer where cores would idle, but at least ``LEAST_CELLS``
PART_CELLS = 1 << 22
LEAST_CELLS = 1 << 16


@dataclass(frozen=True)
class BoostOptions:
    """Settings of a booster; ``max_depth`` or ``max_leaves`` bounds a tree (None: unbounded)."""

    rounds: int = 100
    rate: float = 0.3
    max_depth: int | None = 6
    max_leaves: int | None = None
    l2: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    max_bins: int = 256
    subsample: float = 1.0
    #: factor of the softmax Hessian
    softmax_hessian: float = 2.0
    #: share of rows held back, and rounds without progress of ``tolerance`` on them after which growing ends
    held_back: float = 0.0
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 42


@dataclass
class Tree:
    """A growing tree on bins; ``sums`` are (gradient, Hessian, rows) of a node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple] = field(default_factory=lambda: [(0.0, 0.0, 0.0)])
    best: dict[int, tuple] = field(default_factory=dict)

    def split(self, node: int) -> tuple[int, int]:
        """Splits a node by its best split; its two children."""
        _, f, b, *low = self.best[node]
        high = tuple(x - y for x, y in zip(self.sums[node], low, strict=True))
        self.feature[node], self.cut[node] = f, b
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for sums in (tuple(low), high):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.sums.append(sums)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.feature, self.cut, self.left, self.right))


def walk(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Node each row of ``bins`` rests at."""
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(bins), np.int64)
    if feature[0] < 0:
        return at
    flat, start = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
    inner, step = feature >= 0, np.stack([right, left], axis=1).ravel()
    rows, here = np.arange(len(bins)), at
    while len(rows):
        here = step[2 * here + (flat[start[rows] + feature[here]] <= cut[here])]
        on = inner[here]
        if not on.all():
            at[rows[~on]] = here[~on]
            rows, here = rows[on], here[on]
    return at


def best_first(tree: Tree, max_leaves: int | None) -> tuple[list[int], list[int]]:
    """(nodes a best-first growth splits, those among them not yet split): always the leaf of most gain, up to ``max_leaves``.

    Below a node not yet split nothing is known, so what comes after it is a
    guess; when no such node is left the growth is exact.
    """
    taken, fresh = [], []
    open_ = [(-tree.best[0][0], 0)] if 0 in tree.best else []
    while open_ and (max_leaves is None or len(taken) + 1 < max_leaves):
        node = heapq.heappop(open_)[1]
        taken.append(node)
        if tree.feature[node] < 0:
            fresh.append(node)
        else:
            for child in (tree.left[node], tree.right[node]):
                if child in tree.best:
                    heapq.heappush(open_, (-tree.best[child][0], child))
    return taken, fresh


def pruned(tree: Tree, max_leaves: int | None) -> Tree:
    """The tree without splits that were only tried."""
    keep = set(best_first(tree, max_leaves)[0])
    out, todo = Tree(sums=[tree.sums[0]]), [(0, 0)]
    while todo:
        node, old = todo.pop(0)
        if old in keep:
            out.best[node] = tree.best[old]
            todo += zip(out.split(node), (tree.left[old], tree.right[old]), strict=True)
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Class probabilities; one margin stands for two classes."""
    if margins.shape[1] > 1:
        return softmax(margins)
    p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
    return np.column_stack([1.0 - p, p])


def spread(key: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row keys."""
    with np.errstate(over="ignore"):
        h = key.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


def rows_of(batch: pa.RecordBatch, d: int, k: int) -> tuple[np.ndarray | None, ...]:
    """(key, label, held, bins, margins) of a batch of rows or of packed blocks; the key is None where it was not read."""

    def blob(name: str, kind: type, width: int) -> np.ndarray:
        # values lie side by side, whatever their lengths
        values = batch[name].cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)

    def flat(name: str, kind: type) -> np.ndarray | None:
        if name not in batch.schema.names:
            return None
        if pa.types.is_binary(batch[name].type) or pa.types.is_large_binary(batch[name].type):
            return blob(name, kind, 1)[:, 0]
        return batch[name].to_numpy(zero_copy_only=False)

    return flat("key", np.int64), flat("label", np.int32).astype(np.int64), flat("held", np.bool_).astype(bool), blob("bins", np.uint8, d), blob("margins", np.float64, k).copy()


def blocks_of(batch: pa.RecordBatch, d: int, k: int) -> Iterator[tuple[np.ndarray | None, ...]]:
    """The rows of a batch, ``BLOCK_ROWS`` at a time: what is worked on stays in the cache."""
    columns = rows_of(batch, d, k)
    for at in range(0, len(columns[1]), BLOCK_ROWS):
        yield tuple(x if x is None else x[at : at + BLOCK_ROWS] for x in columns)


def packed(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row that holds a block of rows."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(columns[x]).tobytes()], pa.binary()) for x in PACKED], list(PACKED))


def add_trees(margins: np.ndarray, bins: np.ndarray, pending: list) -> None:
    for output, tree in pending:
        margins[:, output] += tree[4][walk(tree, bins)]


def loss_sums(margins: np.ndarray, label: np.ndarray, held: np.ndarray) -> list[float]:
    p = np.maximum(probabilities(margins)[np.arange(len(label)), label], 1e-300)
    loss = -np.log(p)
    return [float(loss[~held].sum()), float((~held).sum()), float(loss[held].sum()), float(held.sum())]


SUMS = "tree int, node int, feature int, sums binary"
SPLITS = "tree int, node int, feature int, gain double, cut int, g double, h double, n double, all_g double, all_h double, all_n double, at int, low int, high int"
LEAST_GAIN = 1e-12
#: in place of a feature: rows of a narrow node
ROWS = -2


def row_kind(d: int) -> np.dtype:
    return np.dtype([("g", "f8"), ("h", "f8"), ("bins", "u1", (d,))])


def folding(o: BoostOptions, d: int, k: int, turn: int, pending: list, growing: list, front: list[list[int]], narrow: list[list[int]], first: bool):
    """A task's histograms of the open nodes and its rows of the narrow ones; with ``first`` also the losses so far, as node -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = o.max_bins
        totals = [np.zeros((3, d, len(nodes) * width)) for nodes in front]
        losses = np.zeros(4)
        kept: dict[tuple[int, int], list] = {}
        for key, label, held, bins, margins in (x for batch in batches if batch.num_rows for x in blocks_of(batch, d, k)):
            add_trees(margins, bins, pending)
            if first:
                losses += loss_sums(margins, label, held)
            use = ~held
            if o.subsample < 1.0:
                use &= spread(np.ascontiguousarray(key), o.seed * 1_000_003 + turn) < o.subsample
            if not use.all():
                label, bins, margins = label[use], bins[use], margins[use]
            p = probabilities(margins)
            for output in range(k):
                if not front[output] and not narrow[output]:
                    continue
                col = output if k > 1 else 1
                g = p[:, col] - (label == col)
                h = np.maximum(p[:, col] * (1.0 - p[:, col]), 1e-16) * (o.softmax_hessian if k > 1 else 1.0)
                at = walk(growing[output], bins)
                for node in narrow[output]:
                    here = at == node
                    part = np.zeros(here.sum(), row_kind(d))
                    part["g"], part["h"], part["bins"] = g[here], h[here], bins[here]
                    kept.setdefault((output, node), []).append(part)
                if not front[output]:
                    continue
                place = np.full(len(growing[output][0]), -1)
                place[front[output]] = np.arange(len(front[output]))
                slot = place[at]
                keep = slot >= 0
                rows = bins
                if not keep.all():
                    slot, g, h, rows = slot[keep], g[keep], h[keep], bins[keep]
                slot, size = slot * width, len(front[output]) * width
                for j in range(d):
                    where = slot + rows[:, j]
                    for i, weight in enumerate((g, h, None)):
                        totals[output][i, j] += np.bincount(where, weight, size)
        out: dict[str, list] = {"tree": [], "node": [], "feature": [], "sums": []}
        for output, nodes in enumerate(front):
            for s, node in enumerate(nodes):
                for j in range(d):
                    part = totals[output][:, j, s * width : (s + 1) * width]
                    if part[2].any():
                        for name, v in zip(out, (output, node, j, np.ascontiguousarray(part).tobytes()), strict=True):
                            out[name].append(v)
        for (output, node), part in kept.items():
            for name, v in zip(out, (output, node, ROWS, np.concatenate(part).tobytes()), strict=True):
                out[name].append(v)
        if first and losses[1] + losses[3]:
            for name, v in zip(out, (-1, -1, -1, losses.tobytes()), strict=True):
                out[name].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())]))

    return run


def tidy(gain: np.ndarray) -> np.ndarray:
    """Gains to ten digits, so that the order in which sums were added decides no tie."""
    scale = 10.0 ** (9 - np.floor(np.log10(np.maximum(np.abs(gain), 1e-30))))
    return np.round(gain * scale) / scale


def best_cut(sums: np.ndarray, o: BoostOptions) -> tuple:
    """(gain, cut, sums left of it, sums of all) for one histogram (3, bins); gain -1 without an allowed cut. The first of equal cuts counts."""
    total = sums.sum(axis=1)
    low = np.cumsum(sums, axis=1)[:, :-1]
    high = total[:, None] - low
    ok = (low[2] >= o.least_rows) & (high[2] >= o.least_rows) & (low[1] >= o.least_hessian) & (high[1] >= o.least_hessian)
    worth = lambda s: s[0] ** 2 / (s[1] + o.l2 + 1e-300)
    gain = np.where(ok, 0.5 * (worth(low) + worth(high) - worth(total)) - o.least_gain, -1.0)
    if not len(gain):
        return (-1.0, 0, 0.0, 0.0, 0.0, *total)
    gain = tidy(gain)
    b = int(np.argmax(gain))
    return (float(gain[b]), b, *low[:, b], *total)


def histograms(rows: np.ndarray, width: int) -> np.ndarray:
    """(features, 3, bins) sums of the rows."""
    g, h, bins = rows["g"], rows["h"], rows["bins"]
    return np.array([[np.bincount(b, w, width) for w in (g, h, None)] for b in bins.T])


def local_splits(rows: np.ndarray, o: BoostOptions, depth_left: int | None) -> list[tuple]:
    """(feature, best cut..., place, places of its children) of every split below a node, best first; place 0 is the node."""

    def tried(rows: np.ndarray, left: int | None) -> tuple | None:
        if left == 0 or len(rows) < 2:
            return None
        found = [best_cut(sums, o) for sums in histograms(rows, o.max_bins)]
        f = max(range(len(found)), key=lambda j: (found[j][0], -j))
        return (f, found[f]) if found[f][0] > LEAST_GAIN else None

    out, places, todo = [], 1, []
    start = tried(rows, depth_left)
    if start is not None:
        todo.append((-start[1][0], 0, rows, depth_left, start))
    while todo and (o.max_leaves is None or len(out) + 1 < o.max_leaves):
        _, at, rows, left, (f, cut) = heapq.heappop(todo)
        low = rows["bins"][:, f] <= cut[1]
        out.append((f, *cut, at, places, places + 1))
        left = None if left is None else left - 1
        for part in (rows[low], rows[~low]):
            found = tried(part, left)
            if found is not None:
                heapq.heappush(todo, (-found[1][0], places, part, left, found))
            places += 1
    return out


def choosing(o: BoostOptions, d: int, depths: list[dict[int, int]]):
    """The best cut of a histogram, all splits below a narrow node, or the sums of the losses."""
    names = [x.split()[0] for x in SPLITS.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.float64()] * 6 + [pa.int32()] * 3

    def run(table: pa.Table) -> pa.Table:
        tree, node, feature = (table[x][0].as_py() for x in ("tree", "node", "feature"))
        if feature == ROWS:
            rows = np.frombuffer(b"".join(table["sums"].to_pylist()), row_kind(d))
            left = None if o.max_depth is None else o.max_depth - depths[tree][node]
            found = [(tree, node, *split) for split in local_splits(rows, o, left)]
            if not found:
                total = (float(rows["g"].sum()), float(rows["h"].sum()), float(len(rows)))
                found = [(tree, node, 0, -1.0, 0, 0.0, 0.0, 0.0, *total, 0, 0, 0)]
        else:
            sums = sum(np.frombuffer(x, np.float64) for x in table["sums"].to_pylist())
            best = (0.0, 0, *sums[:4], 0.0, 0.0) if tree < 0 else best_cut(sums.reshape(3, -1), o)
            found = [(tree, node, feature, *best, 0, 0, 0)]
        return pa.table([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return run


def refreshing(d: int, k: int, pending: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, label, held, bins, margins in (x for batch in batches if batch.num_rows for x in blocks_of(batch, d, k)):
            add_trees(margins, bins, pending)
            yield packed({"key": key, "label": label.astype(np.int32), "held": held, "bins": bins, "margins": margins})

    return run


def cut_points(rows: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature of ``v``: midpoints between its values if they are few, else quantiles.

    One aggregate, and for narrow features a second one over their distinct values.
    """
    shares = [i / max_bins for i in range(1, max_bins)]
    # few expressions of any width: a wide aggregate would compile badly
    long = rows.select(F.posexplode("v").alias("j", "x")).where("x is not null and not isnan(x)")
    facts = long.groupBy("j").agg(F.approx_count_distinct("x", 0.02).alias("n"), F.percentile_approx("x", shares, 10_000).alias("q")).collect()
    out = [np.zeros(0)] * d
    few = [r["j"] for r in facts if r["n"] <= max_bins]
    for r in facts:
        out[r["j"]] = np.unique(np.array(r["q"], float))
    if few:
        for r in long.where(F.col("j").isin(few)).groupBy("j").agg(F.array_sort(F.collect_set("x")).alias("x")).collect():
            values = np.array(r["x"], float)
            if len(values) <= max_bins:
                out[r["j"]] = (values[1:] + values[:-1]) / 2
    return out


def bin_numbers(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the values; NaN falls into the last one."""
    return np.column_stack([np.searchsorted(e, np.where(np.isnan(x[:, j]), np.inf, x[:, j]), "left") for j, e in enumerate(cuts)]).astype(np.uint8)


def binning(cuts: list[np.ndarray], base: np.ndarray, held_back: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[np.ndarray, ...]] = []

        def whole() -> pa.RecordBatch:
            key, label, bins = (np.concatenate(x) for x in zip(*block, strict=True))
            return packed({"key": key, "label": label, "held": spread(key, seed + 77) < held_back, "bins": bins, "margins": np.tile(base, (len(key), 1))})

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            key, label = (batch[name].to_numpy(zero_copy_only=False) for name in ("key", "label"))
            block.append((key.astype(np.int64), label.astype(np.int32), bin_numbers(x, cuts)))
            if sum(len(part[0]) for part in block) >= BLOCK_ROWS:
                yield whole()
                block = []
        if block:
            yield whole()

    return run


#: columns of packed blocks
PACKED = ("key", "label", "held", "bins", "margins")
STATE = ", ".join(f"{x} binary" for x in PACKED)


@dataclass
class Booster:
    """A fitted booster: starting margins and a forest of margins per class output."""

    base: np.ndarray
    forest: Forest
    rounds: int
    losses: list[tuple[float, float]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.forest.scores(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return probabilities(self.margins(x))


def grow(state: DataFrame, o: BoostOptions, d: int, k: int, turn: int, n: float, parts: int, pending: list) -> tuple[list[Tree], tuple]:
    """The trees of a round, one for each output, level by level; and the losses before it. ``n``: rows at a root, ``parts``: partitions of the rows."""
    trees = [Tree(sums=[(0.0, 0.0, n)]) for _ in range(k)]
    open_ = [[0] for _ in range(k)]
    losses = None
    # a node's rows and its histograms as they would be shuffled
    row_bytes, sums_bytes = row_kind(d).itemsize, d * 3 * 8 * o.max_bins

    def finished(t: Tree, x: int) -> bool:
        """Whether one task takes a node's rows; with one level left its histograms do as much, and are often smaller."""
        last = o.max_depth is not None and t.depth[x] == o.max_depth - 1
        return t.sums[x][2] <= NARROW_ROWS and not (last and t.sums[x][2] * row_bytes > parts * sums_bytes)

    state = state if o.subsample < 1.0 else state.drop("key")
    while any(open_):
        first = losses is None
        narrow = [[x for x in nodes if finished(t, x)] for t, nodes in zip(trees, open_, strict=True)]
        front = [[x for x in nodes if not finished(t, x)] for t, nodes in zip(trees, open_, strict=True)]
        depths = [{x: t.depth[x] for x in nodes} for t, nodes in zip(trees, narrow, strict=True)]
        sums = state.mapInArrow(folding(o, d, k, turn, pending, [t.arrays() for t in trees], front, narrow, first), SUMS)
        found = sums.groupBy("tree", "node", "feature").applyInArrow(choosing(o, d, depths), SPLITS).collect()
        losses = losses or (math.nan, math.nan)
        below: dict[tuple[int, int], list] = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"], -r["gain"], r["feature"])):
            if r["tree"] < 0:
                mean = lambda total, rows: total / rows if rows else math.nan
                losses = (mean(r["g"], r["h"]), mean(r["n"], r["all_g"]))
                continue
            tree, node = trees[r["tree"]], r["node"]
            if node == 0 and r["at"] == 0:
                tree.sums[0] = (r["all_g"], r["all_h"], r["all_n"])
            if node in depths[r["tree"]]:
                below.setdefault((r["tree"], node), []).append(r)
            elif r["gain"] > LEAST_GAIN and node not in tree.best:
                tree.best[node] = (r["gain"], r["feature"], r["cut"], r["g"], r["h"], r["n"])
        open_ = []
        for output, tree in enumerate(trees):
            new = [child for node in best_first(tree, o.max_leaves)[1] for child in tree.split(node)]
            for node in narrow[output]:
                places = {0: node}
                for r in sorted(below.get((output, node), []), key=lambda r: r["low"]):
                    if r["gain"] > LEAST_GAIN:
                        tree.best[places[r["at"]]] = (r["gain"], r["feature"], r["cut"], r["g"], r["h"], r["n"])
                        places[r["low"]], places[r["high"]] = tree.split(places[r["at"]])
            if o.max_leaves is not None and narrow[output]:
                # what a narrow node brought may outweigh splits guessed before
                new += [child for node in best_first(tree, o.max_leaves)[1] for child in tree.split(node)]
            open_.append([x for x in new if o.max_depth is None or tree.depth[x] < o.max_depth])
    return [pruned(t, o.max_leaves) for t in trees], losses


def short_jobs(spark: SparkSession, parts: int) -> SparkSession:
    """A session for many small jobs of one known shape: no adaptive planning, as many reducers as the rows have partitions, up to the usual number."""
    out = spark.newSession()
    out.conf.set("spark.sql.adaptive.enabled", "false")
    out.conf.set("spark.sql.shuffle.partitions", str(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    out.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that this module wrote and no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions(cells: int, cores: int) -> int:
    """Partitions of a booster's rows: all cores at work where that leaves each enough, and none larger than ``PART_CELLS``."""
    return max(1, math.ceil(cells / PART_CELLS), min(cores, math.ceil(cells / LEAST_CELLS)))


def fit_booster(rows: DataFrame, d: int, n_classes: int, options: BoostOptions) -> Booster:
    """Boosts on (key, label, v) rows: a row hash, a class code, ``d`` numbers. Two classes share one margin."""
    o, k = options, 1 if n_classes <= 2 else n_classes
    if not 2 <= o.max_bins <= 256:
        raise ValueError("max_bins must lie between 2 and 256")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    share = np.array([max(counts.get(i, 0), 1e-9) / max(n, 1) for i in range(max(n_classes, 2))])
    base = np.log(share) if k > 1 else np.array([math.log(share[1] / share[0])])
    cuts = cut_points(rows, d, o.max_bins)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = partitions(n * max(d, 2 * k), cores)
    # full turns of all cores: a last task alone would double the time of a pass
    parts = parts if parts <= cores else math.ceil(parts / cores) * cores
    binned = rows.select("key", c("label").cast("int").alias("label"), "v").repartition(parts, "key")
    quick = short_jobs(rows.sparkSession, parts)

    kept: list[str] = []

    def written(state: DataFrame) -> DataFrame:
        kept.append(scratch_path(rows.sparkSession, "boost-rows"))
        state.write.parquet(kept[-1])
        for old in kept[:-1]:
            drop_table(rows.sparkSession, old)
        del kept[:-1]
        return quick.read.schema(STATE).parquet(kept[0])

    refresh = REFRESH if n * o.subsample <= NARROW_ROWS else 1
    state = written(binned.mapInArrow(binning(cuts, base, o.held_back, o.seed), STATE))
    done: list[tuple[int, Tree, np.ndarray]] = []
    pending: list = []
    losses: list[tuple[float, float]] = []
    for turn in range(o.rounds):
        trees, loss = grow(state, o, d, k, turn, n * o.subsample, parts, pending)
        losses.append(loss)
        if o.held_back and len(losses) > o.patience:
            past = losses[-o.patience - 1][1]
            if min(x[1] for x in losses[-o.patience :]) >= past - o.tolerance:
                break
        if all(len(t.feature) == 1 for t in trees):
            break
        for output, tree in enumerate(trees):
            sums = np.array(tree.sums)
            value = -o.rate * sums[:, 0] / (sums[:, 1] + o.l2 + 1e-300)
            done.append((output, tree, value))
            pending.append((output, (*tree.arrays(), value)))
        if (turn + 1) % refresh == 0 and turn + 1 < o.rounds:
            state = written(state.mapInArrow(refreshing(d, k, pending), STATE))
            pending = []
    return Booster(base, flat(done, cuts, d, k), len(done) // k, losses)


def flat(done: list[tuple[int, Tree, np.ndarray]], cuts: list[np.ndarray], d: int, k: int) -> Forest:
    """One forest of the trees of all outputs, bins turned back into thresholds."""
    roots, parts, at = [], [], 0
    for output, tree, value in done:
        feature, cut, left, right = tree.arrays()
        inner = feature >= 0
        threshold = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut, strict=True)])
        values = np.zeros((len(feature), k))
        values[~inner, output] = value[~inner]
        parts.append((feature, threshold, np.where(inner, left + at, -1), np.where(inner, right + at, -1), values, np.array(tree.sums)[:, 2]))
        roots.append(at)
        at += len(feature)
    if not parts:
        none = np.zeros(0)
        return Forest(np.zeros(0, np.int64), none.astype(np.int64), none, none.astype(np.int64), none.astype(np.int64), np.zeros((0, k)), none, d)
    return Forest(np.array(roots), *(np.concatenate(x) for x in zip(*parts, strict=True)), d)
