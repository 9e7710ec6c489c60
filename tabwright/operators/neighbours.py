"""Exact distance joins cut into bounded blocks.

Points are assigned to the nearest of a few pivots. A point within radius r of
a query can only lie in cells the triangle inequality leaves open, so a query
is sent to those cells alone. Inside a cell both sides are split into blocks of
bounded size: a cell holding a third of the table becomes many tasks. A block
pair returns per-query results (nearest k, sums, counts or a spanning forest),
never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, order_key
from tabwright.session import write_through

BLOCK_ROWS = 4096
#: cells of a block pair that are worked on at a time
STRIP_CELLS = 1 << 16
#: bytes of vectors in one frame of (query, open cell) rows
SPREAD_BYTES = 1 << 23
MAX_PIVOTS = 256
#: mean distances: blocks a table falls into before blocks grow, and rows at which they stop growing
MOST_BLOCKS, WIDEST_BLOCK = 32, 1 << 15
SLACK = 1e-9  # relative allowance for rounding in distance bounds
#: columns from which products narrow a search before differences are taken
PRODUCT_COLUMNS = 8
#: rows that share a window in a search over fewer columns
WINDOW_ROWS = 64

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def with_vector(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(
        *[c(k) for k in keep], F.array(*[c(x).cast("double") for x in features]).alias("v")
    )


def vector_points(df: DataFrame, features: Sequence[str], row_id: str) -> DataFrame:
    """(id, v) from feature columns."""
    return with_vector(df, features, [row_id]).withColumnRenamed(row_id, "id")


def matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def strips(rows: int, columns: int) -> Iterator[slice]:
    """Runs of rows of a block, each of about ``STRIP_CELLS`` cells."""
    step = max(1, STRIP_CELLS // max(columns, 1))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def distances(a: np.ndarray, b: np.ndarray, squared: bool = False) -> np.ndarray:
    """Pairwise Euclidean distances of one block; differences, not dot products, so equal points give 0.

    Strip by strip: what is added up stays in the cache, and no second block is held.
    """
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for s in strips(*out.shape):
        part = out[s]
        if not a.shape[1]:
            continue
        np.subtract(a[s, 0, None], columns[0], out=part)
        np.multiply(part, part, out=part)
        step = np.empty_like(part)
        for j in range(1, a.shape[1]):
            np.subtract(a[s, j, None], columns[j], out=step)
            np.multiply(step, step, out=step)
            part += step
        if not squared:
            np.sqrt(part, out=part)
    return out


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """(row of a, row of b): are they within ``radius``?"""
    out = np.empty((len(a), len(b)), bool)
    for s in strips(*out.shape):
        out[s] = distances(a[s], b) <= radius
    return out


def squares_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of row pairs, added up in the order of ``distances``."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        step = x - y
        out += step * step
    return out


def closest(a: np.ndarray, b: np.ndarray, take: int, most: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, squared distance), some rows at a time: all pairs that may be among the ``take`` nearest of a row of ``a``.

    With many columns a matrix product finds the candidates, with room for its
    rounding, with few a window along the widest column; the distances handed on
    are always those of ``distances``. Pairs beyond ``most`` may be left out.
    """
    plain = not (np.isfinite(a).all() and np.isfinite(b).all())
    if not plain and a.shape[1] < PRODUCT_COLUMNS:
        yield from windows(a, b, take, np.full(len(a), np.inf) if most is None else most)
        return
    if not plain:
        sa, sb, eps = (a * a).sum(axis=1), (b * b).sum(axis=1), np.finfo(float).eps
        room = 4 * (a.shape[1] + 8) * eps * (np.sqrt(sa) + np.sqrt(sb.max())) ** 2
        plain = not np.isfinite(room).all()
    for s in strips(len(a), len(b)):
        d = distances(a[s], b, squared=True) if plain else sa[s, None] + sb - 2 * (a[s] @ b.T)
        edge = np.partition(d, take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero(d <= (edge if plain else edge + 2 * room[s])[:, None])
        yield i + s.start, j, d[i, j] if plain else squares_of(a[i + s.start], b[j])


def windows(a: np.ndarray, b: np.ndarray, take: int, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``closest`` by runs of rows along one column; a run's window grows until nothing outside can be near enough."""
    column = int(np.argmax(b.max(axis=0) - b.min(axis=0)))
    place, turn = np.argsort(b[:, column], kind="stable"), np.argsort(a[:, column], kind="stable")
    b = b[place]
    xs, n = b[:, column], len(b)
    for at in range(0, len(turn), WINDOW_ROWS):
        rows = turn[at : at + WINDOW_ROWS]
        x, far = a[rows, column], most[rows]
        wide = np.sqrt(far.max()) * (1 + SLACK)
        first, last = np.searchsorted(xs, x[0] - wide, "left"), np.searchsorted(xs, x[-1] + wide, "right")
        step = max(4 * take, n // 64)
        low, high = max(first, np.searchsorted(xs, x[0]) - step), min(last, np.searchsorted(xs, x[-1], "right") + step)
        while True:
            low, high = min(low, high), max(low, high)
            d = distances(a[rows], b[low:high], squared=True)
            edge = np.partition(d, take - 1, axis=1)[:, take - 1] if high - low >= take else np.full(len(rows), np.inf)
            need = np.minimum(edge, far)
            left = low <= first or ((x - xs[low - 1]) ** 2 > need).all()
            right = high >= last or ((xs[high] - x) ** 2 > need).all()
            if left and right:
                break
            step *= 2
            low, high = low if left else max(first, low - step), high if right else min(last, high + step)
        i, j = np.nonzero(d <= need[:, None])
        yield rows[i], place[low + j], d[i, j]


@dataclass(frozen=True)
class Cells:
    """Pivots and, per cell: points, largest distance to the pivot, k-th smallest distance."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    kth: np.ndarray  # inf where the cell has fewer than k points
    k: int

    def splits(self, block: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self.count / block)).astype(int)


def choose_pivots(points: DataFrame, seed: int = 42) -> np.ndarray:
    """A seeded handful of points, √n of them but at most MAX_PIVOTS."""
    n = points.count()
    want = min(MAX_PIVOTS, max(1, math.isqrt(n) // 2))
    rows = (
        points.select("v", order_key(seed, F.col("id")).alias("h")).orderBy("h").limit(want).collect()
    )
    return np.unique(np.array([r["v"] for r in rows], dtype=float), axis=0)


def assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` and ``pd`` (distance to its pivot) to (.., v)."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(matrix(b["v"]), pivots)
                at = d.argmin(axis=1)
                b = b.assign(cell=at.astype("int32"), pd=d[np.arange(len(b)), at])
            else:
                b = b.assign(cell=pd.Series(dtype="int32"), pd=pd.Series(dtype="float64"))
            yield b

    from pyspark.sql import types as T

    schema = T.StructType(
        [*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("pd", T.DoubleType())]
    )
    return points.mapInPandas(nearest, schema)


def cell_facts(assigned: DataFrame, pivots: np.ndarray, k: int = 1) -> Cells:
    """Per-cell counts and radii; the k-th smallest distance via salted partial ranks."""
    size = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("pd").alias("r"))
    salted = assigned.select("cell", "pd", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    first = salted.withColumn(
        "i", F.row_number().over(Window.partitionBy("cell", "salt").orderBy("pd"))
    ).where(F.col("i") <= k)
    second = first.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("pd"))).where(
        F.col("i") == k
    )
    rows = size.join(second.select("cell", F.col("pd").alias("kth")), "cell", "left").collect()
    m = len(pivots)
    count, radius, kth = np.zeros(m), np.zeros(m), np.full(m, np.inf)
    for r in rows:
        count[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
        if r["kth"] is not None:
            kth[r["cell"]] = r["kth"]
    return Cells(pivots, count, radius, kth, k)


def plain(col: pd.Series) -> pd.Series:
    """Texts as objects: a text column in chunks does not go back to Spark."""
    return col if col.dtype.kind in "iufb" else col.astype(object)


def per_open_cell(b: pd.DataFrame, ok: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row of ``b`` for each cell marked in its row of ``ok``, in frames of bounded size."""
    i, j = np.nonzero(ok)
    step = max(1, SPREAD_BYTES // (8 * max(len(b["v"].iloc[0]), 1)))
    for at in range(0, len(i), step):
        out = b.iloc[i[at : at + step]].reset_index(drop=True)
        out["cell"] = j[at : at + step].astype("int32")
        if "id" in out:
            out["id"] = plain(out["id"])
        yield out


def sure_reach(d: np.ndarray, cells: Cells) -> np.ndarray:
    """The smallest radius sure to hold k points, of queries at distances ``d`` from the pivots."""
    # whole cells taken in by far edge until k points are sure
    far = np.where(cells.count > 0, d + cells.radius, np.inf)
    order = np.argsort(far, axis=1)
    enough = np.cumsum(cells.count[order], axis=1) >= cells.k
    whole = np.take_along_axis(far, order, axis=1)[np.arange(len(d)), enough.argmax(axis=1)]
    return np.minimum((d + cells.kth).min(axis=1), whole)


def may_hold(d: np.ndarray, cells: Cells, reach: np.ndarray) -> np.ndarray:
    """(query, cell): may the cell hold a point within the query's reach?"""
    return (d - cells.radius <= (reach * (1 + SLACK) + SLACK)[:, None]) & (cells.count > 0)


def beyond_border(d: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(query, cell): at least so far is the border between the cell and the one the query lies in."""
    nearest = d.argmin(axis=1)
    apart = 2 * distances(pivots, pivots)[nearest]
    square = d**2 * (1 - SLACK) - (d[np.arange(len(d)), nearest] ** 2 * (1 + SLACK))[:, None]
    return np.divide(square, apart, out=np.full(d.shape, -np.inf), where=apart > 0)


def open_cells(queries: DataFrame, cells: Cells, radius: float | None) -> DataFrame:
    """One row per (query, cell that may hold an answer).

    ``radius`` None: queries have a ``home``, a cell they were at already, and a ``reach``.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = distances(matrix(b["v"]), cells.pivots)
            if radius is None:
                reach, away = b["reach"].to_numpy(), b["home"].to_numpy() >= 0
                ok = may_hold(d, cells, reach)
                ok &= beyond_border(d, cells.pivots) <= (reach * (1 + SLACK) + SLACK)[:, None]
                ok[np.flatnonzero(away), b["home"].to_numpy()[away]] = False
            else:
                ok = may_hold(d, cells, np.full(len(b), radius))
            yield from per_open_cell(b, ok)

    from pyspark.sql import types as T

    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
    return queries.mapInPandas(spread, schema)


def at_home(queries: DataFrame, cells: Cells) -> DataFrame:
    """Adds ``home``, the cell of the nearest pivot (-1 if it is closed), and ``reach`` to (id, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(matrix(b["v"]), cells.pivots)
                reach, home = sure_reach(d, cells), d.argmin(axis=1)
                ok = may_hold(d, cells, reach)[np.arange(len(b)), home]
                # rows are taken anew: a text column may come in chunks
                out = b.iloc[np.arange(len(b))].reset_index(drop=True)
                out["home"], out["reach"] = np.where(ok, home, -1).astype("int32"), reach
                yield out

    from pyspark.sql import types as T

    schema = T.StructType([*queries.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("reach", T.DoubleType())])
    return queries.mapInPandas(run, schema)


def rows_per_cell(queries: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def block_join(
    queries: DataFrame,
    points: DataFrame,
    point_splits: np.ndarray,
    kernel: Kernel,
    schema: str,
    block: int = BLOCK_ROWS,
    per_cell: dict[int, int] | None = None,
) -> DataFrame:
    """Run ``kernel(query block, point block)`` for every block pair of every cell; ``per_cell`` counts the queries, if known."""
    spark = queries.sparkSession
    per_cell = rows_per_cell(queries) if per_cell is None else per_cell
    m = len(point_splits)
    q_splits = [max(1, math.ceil(per_cell.get(i, 0) / block)) for i in range(m)]
    p_splits = [int(x) for x in point_splits]

    def at(values: list[int]):
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cell") + 1)

    q = queries.withColumn("qs", F.pmod(F.xxhash64("id"), at(q_splits)).cast("int")).withColumn(
        "ps", F.explode(F.sequence(F.lit(0), at(p_splits) - 1))
    )
    # fresh column identities: both sides may come from one table
    p = points.toDF(*points.columns).withColumn("ps", F.pmod(F.xxhash64("id"), at(p_splits)).cast("int")).withColumn(
        "qs", F.explode(F.sequence(F.lit(0), at(q_splits) - 1))
    )
    # blocks cost time, not bytes: a fixed partition count keeps them from being merged
    work = sum(a * b for a, b in zip(q_splits, p_splits, strict=True))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(work, 20_000))
    keys = ["cell", "qs", "ps"]
    left = q.repartition(parts, *keys).groupBy(*keys)
    right = p.repartition(parts, *keys).groupBy(*keys)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b)

    return left.cogroup(right).applyInPandas(run, schema)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    payload: str | None = None,
    payload_type: str = "bigint",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest points of each query: (query_id, point_id, d2, rank[, payload]).

    ``queries(id, v)``, ``points(id, v[, payload])``; ordered by squared distance,
    then point id.
    """
    if points.limit(k).count() < k:
        raise ValueError(f"{k} neighbours asked of fewer points")
    # of equal points only the k smallest ids can be answers; equal queries share one answer.
    # The rank limit works before the shuffle, so a spot holding a third of the rows stays small.
    spot = Window.partitionBy("v").orderBy("id")
    points = points.withColumn("__i", F.row_number().over(spot)).where(F.col("__i") <= k).drop("__i")
    everyone = queries.select(F.col("id").alias("query_id"), "v")
    queries = queries.groupBy("v").agg(F.min("id").alias("id"))
    pivots = choose_pivots(points)
    assigned = assign_cells(points, pivots)
    cells = cell_facts(assigned, pivots, k)
    extra = [payload] if payload else []
    kind = queries.schema["id"].dataType.simpleString()
    point_kind = points.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, point_id {point_kind}, d2 double" + (
        f", {payload} {payload_type}" if payload else ""
    )
    names = ["query_id", "point_id", "d2", *extra]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        most = a["most"].to_numpy() if "most" in a else np.full(len(a), np.inf)
        left, right, ids = matrix(a["v"]), matrix(b["v"]), b["id"].to_numpy()
        take = min(k, len(ids))
        found = []
        for i, j, d in closest(left, right, take, most):
            order = np.lexsort((ids[j], d, i))
            i, j, d = i[order], j[order], d[order]
            ok = (np.arange(len(i)) - np.searchsorted(i, i) < take) & (d <= most[i])
            found.append((i[ok], j[ok], d[ok]))
        i, j, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            # plain lists: an empty text column would have no chunk
            return pd.DataFrame({n: [] for n in names})
        asked_by = a["id"].to_numpy()[i]
        out = {"query_id": pd.Series(asked_by, dtype=asked_by.dtype), "point_id": ids[j], "d2": d2}
        if payload:
            out[payload] = b[payload].to_numpy()[j]
        return pd.DataFrame(out)

    # first the own cell, whose answers bound what other cells are asked for
    n, side = queries.count(), assigned.select("id", "v", "cell", *extra)
    placed = write_through(at_home(queries.select("id", "v"), cells), "queries")
    own = placed.where("home >= 0").select("id", "v", F.col("home").alias("cell"))
    found = write_through(block_join(own, side, cells.splits(block), kernel, schema, block), "nearest")
    most = found.groupBy(F.col("query_id").alias("id")).agg(F.get(F.array_sort(F.collect_list("d2")), k - 1).alias("most"))
    bound = F.coalesce("most", F.lit(math.inf))
    rest = placed.join(most, "id", "left").select("id", "v", "home", F.least("reach", F.sqrt(bound)).alias("reach"), bound.alias("most"))
    asked = open_cells(rest, cells, None).select("id", "v", "most", "cell")
    per_cell = rows_per_cell(asked)
    if sum(m * cells.count[i] for i, m in per_cell.items()) > n * cells.count.sum() / 2:
        # hardly a cell is closed: one cell of all points sends a query to each block of points, not to each cell
        asked = placed.select("id", "v", F.lit(0).alias("cell"))
        splits = np.array([max(1, math.ceil(cells.count.sum() / block))])
        found = block_join(asked, side.withColumn("cell", F.lit(0)), splits, kernel, schema, block, {0: n})
    elif per_cell:
        found = found.unionByName(block_join(asked, side, cells.splits(block), kernel, schema, block, per_cell))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "point_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    spots = queries.select(F.col("id").alias("query_id"), "v")
    answers = best.join(spots, "query_id").drop("query_id")
    return everyone.join(answers, "v").drop("v").select(*names, "rank")


def merge_equal(points: DataFrame) -> DataFrame:
    """(id, v, w): one row per spot, with the smallest id and the number of points there."""
    return points.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))


def count_within(points: DataFrame, radius: float, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, n): points within ``radius`` of each point, itself included.

    A column ``w`` gives the number of points a row stands for (default 1).
    """
    if "w" not in points.columns:
        points = points.withColumn("w", F.lit(1).cast("long"))
    pivots = choose_pivots(points)
    assigned = assign_cells(points, pivots)
    cells = cell_facts(assigned, pivots)
    kind = points.schema["id"].dataType.simpleString()

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "n": []})
        left, right, w = matrix(a["v"]), matrix(b["v"]), b["w"].to_numpy(dtype="int64")
        counts = [(distances(left[s], right) <= radius) @ w for s in strips(len(left), len(right))]
        return pd.DataFrame({"id": a["id"], "n": np.concatenate(counts)})

    asked = open_cells(points.select("id", "v"), cells, radius)
    found = block_join(
        asked, assigned.select("id", "v", "cell", "w"), cells.splits(block), kernel, f"id {kind}, n bigint", block
    )
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def forest(near: np.ndarray) -> np.ndarray:
    """Smallest reachable row of the bipartite block graph, for rows then columns."""
    rows, cols = near.shape
    lab = np.arange(rows + cols)
    while True:
        new = lab.copy()
        # each row takes the least label among its columns, then back
        for s in strips(rows, cols):
            least = np.where(near[s], lab[None, rows:], rows + cols).min(axis=1, initial=rows + cols)
            new[s] = np.minimum(lab[s], least)
        for s in strips(rows, cols):
            least = np.where(near[s], new[s, None], rows + cols).min(axis=0, initial=rows + cols)
            new[rows:] = np.minimum(new[rows:], least)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def links_within(points: DataFrame, radius: float, block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) edges whose components equal those of the full radius graph.

    Each block pair gives one edge per point at most, to the root of its
    component inside the block.
    """
    pivots = choose_pivots(points)
    assigned = assign_cells(points, pivots)
    cells = cell_facts(assigned, pivots)
    kind = points.schema["id"].dataType.simpleString()

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        lab = forest(within(matrix(a["v"]), matrix(b["v"]), radius))
        ids = np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])
        out = pd.DataFrame({"a": ids, "b": ids[lab]})
        return out[out["a"] != out["b"]]

    asked = open_cells(points.select("id", "v"), cells, radius)
    return block_join(
        asked, assigned.select("id", "v", "cell"), cells.splits(block), kernel, f"a {kind}, b {kind}", block
    ).distinct()


def mean_distances(points: DataFrame, group: str, weight: str, block: int = BLOCK_ROWS) -> DataFrame:
    """(t_own, b, n_own, w) of every point: summed distance to its own group, least mean distance to another one.

    Inherently every point against every other: no bound can close a cell. Points
    of a group lie in blocks of their own, small groups together and whole, so a
    block of points is one packed row and a pair of blocks gives a sum or a least
    mean per point, however many groups there are. Blocks grow with the table, by
    which pairs stay few; pairs of two large groups are worked on once for both.
    """
    d = write_through(points.select(F.col(group).alias("group"), "v", F.col(weight).alias("w")), "points")
    d = write_through(d.withColumn("id", F.monotonically_increasing_id()), "points")
    # null is no group: its points have no distances, only a weight
    groups = d.where("group is not null").groupBy("group").agg(
        F.min("id").alias("g"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    groups = write_through(groups, "groups")
    n = groups.agg(F.sum("rows")).first()[0] or 0
    width = len((d.select("v").first() or [[0.0]])[0])
    rows = max(1, min(max(block, n // MOST_BLOCKS), max(block, WIDEST_BLOCK), max(1, SPREAD_BYTES // (8 * max(width, 1)))))
    large = F.col("rows") > rows // 4
    small = groups.where(~large).agg(F.sum("rows")).first()[0] or 0
    bins = max(1, math.ceil(2 * small / rows))
    home = F.when(large, F.col("g")).otherwise(-1 - F.pmod(F.xxhash64("g"), F.lit(bins)))
    parts = F.when(large, F.ceil(F.col("rows") / F.lit(rows))).otherwise(1)
    placed = d.join(groups.select("group", "g", "n", home.alias("home"), parts.alias("parts")), "group").withColumn(
        "part", F.pmod(F.xxhash64("id"), "parts").cast("int")
    )

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["g", "id"])
        sides = (matrix(b["v"]), b["w"].to_numpy("float64"), b["g"].to_numpy("int64"), b["n"].to_numpy("float64"))
        return pd.DataFrame([[b["home"].iloc[0], b["part"].iloc[0], *[x.tobytes() for x in sides]]], columns=["home", "part", "v", "w", "g", "n"])

    packed = write_through(
        placed.select("home", "part", "id", "v", "w", "g", "n").groupBy("home", "part").applyInPandas(pack, "home bigint, part int, v binary, w binary, g binary, n binary"),
        "blocks",
    )
    one = packed.select("home", "part")
    other = one.toDF("home2", "part2")
    apart = (F.col("home") < 0) | (F.col("home2") < 0)
    pairs = write_through(one.crossJoin(other).where(apart | (F.struct("home", "part") <= F.struct("home2", "part2"))), "pairs")
    keys = ["home", "part", "home2", "part2"]
    # pairs cost time, not bytes: a fixed partition count keeps them from being merged
    tasks = max(1, min(pairs.count(), 20_000))
    left = pairs.join(packed, ["home", "part"]).repartition(tasks, *keys).groupBy(*keys)
    # fresh column identities: both sides come from one table
    again, mate = pairs.toDF(*keys), packed.toDF("home2", "part2", *packed.columns[2:])
    right = again.join(mate, ["home2", "part2"]).repartition(tasks, *keys).groupBy(*keys)

    def sides(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, g, n = (np.frombuffer(b[x].iloc[0], t) for x, t in (("w", "f8"), ("g", "i8"), ("n", "f8")))
        return np.frombuffer(b["v"].iloc[0], "f8").reshape(len(w), -1), w, g, n

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        (x, wx, gx, _), (y, wy, gy, ny) = sides(a), sides(b)
        home, part, home2, part2 = (int(a[k].iloc[0]) for k in keys)
        same = (home, part) == (home2, part2)
        starts = np.flatnonzero(np.r_[True, gy[1:] != gy[:-1]])
        ends = np.r_[starts[1:], len(gy)]
        whole = home2 < 0
        back = np.zeros(len(y)) if home >= 0 and home2 >= 0 and not same else None
        there, own = np.zeros(len(x)), np.zeros(len(x) if same and whole else 0)
        for s in strips(len(x), len(y)):
            far = distances(x[s], y)
            if not whole:
                there[s] = far @ wy
                if back is not None:
                    back += wx[s] @ far
                continue
            far *= wy
            if len(starts) * 16 < len(y):
                total = np.stack([far[:, i:j].sum(axis=1) for i, j in zip(starts, ends, strict=True)], axis=1)
            else:
                total = np.add.reduceat(far, starts, axis=1)
            mean = total / ny[starts]
            if same:
                at = np.searchsorted(gy[starts], gx[s])
                own[s] = total[np.arange(len(at)), at]
                mean[np.arange(len(at)), at] = np.inf
            # fmin: a sum that is not a number loses to any that is
            there[s] = np.fmin.reduce(mean, axis=1)
        out = [(home, part, -1 if whole else int(gy[0]), float(ny[0]), there.tobytes(), own.tobytes())]
        if back is not None:
            out.append((home2, part2, int(gx[0]), float(sides(a)[3][0]), back.tobytes(), b""))
        return pd.DataFrame(out, columns=["home", "part", "g", "n", "there", "own"])

    found = left.cogroup(right).applyInPandas(run, "home bigint, part int, g bigint, n double, there binary, own binary")
    block_of = found.groupBy("home", "part").cogroup(packed.select("home", "part", "w", "g", "n").toDF("home", "part", "w", "g", "n").groupBy("home", "part"))

    def settle(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        w, g, n = (np.frombuffer(p[x].iloc[0], t) for x, t in (("w", "f8"), ("g", "i8"), ("n", "f8")))
        own, least = np.zeros(len(w)), np.full(len(w), np.inf)
        totals: dict[int, list] = {}
        for q, m, there, mine in zip(f["g"], f["n"], f["there"], f["own"], strict=True):
            there = np.frombuffer(there, "f8")
            if q < 0:
                least = np.fmin(least, there)
                own += np.frombuffer(mine, "f8") if len(mine) else 0.0
            elif q in totals:
                totals[q][0] += there
            else:
                totals[q] = [there.copy(), m]
        for q, (total, m) in totals.items():
            # a large group fills its blocks alone
            if q == g[0] and p["home"].iloc[0] >= 0:
                own = total
            else:
                least = np.fmin(least, total / m)
        return pd.DataFrame({"t_own": own, "b": [x if x < np.inf or x != x else None for x in least], "n_own": n.astype("int64"), "w": w.astype("int64")})

    terms = "t_own double, b double, n_own bigint, w bigint"
    rest = d.where("group is null").selectExpr("CAST(NULL AS DOUBLE) AS t_own", "CAST(NULL AS DOUBLE) AS b", "CAST(NULL AS BIGINT) AS n_own", "w")
    return block_of.applyInPandas(settle, terms).unionByName(rest)


def weighted_product(
    points: DataFrame, gamma: float, vectors: DataFrame, width: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """(id, y): y = Σ_j exp(-gamma·|x_i - x_j|²)·u_j, the kernel matrix never written down.

    ``vectors(id, u)`` holds one array of ``width`` numbers per point.
    """
    n = points.count()
    splits = np.array([max(1, math.ceil(n / block))])
    kind = points.schema["id"].dataType.simpleString()
    both = points.join(vectors, "id").withColumn("cell", F.lit(0))

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "part": []})
        w = np.exp(-gamma * distances(matrix(a["v"]), matrix(b["v"]), squared=True))
        return pd.DataFrame({"id": a["id"], "part": list(w @ matrix(b["u"]))})

    parts = block_join(
        both.select("id", "v", "cell"), both.select("id", "v", "u", "cell"), splits, kernel,
        f"id {kind}, part array<double>", block,
    )
    return parts.groupBy("id").agg(
        F.array(*[F.sum(F.col("part")[i]) for i in range(width)]).alias("y")
    )
