"""A feed-forward classifier trained by mini-batches: Adam with L2 penalty and early stopping.

Rows are dealt to shards by a seeded hash. In a round every shard takes the
common weights and Adam moments, steps through its own mini-batches, and the
results are averaged by rows: one job a round, in which only weights travel. A
table of up to ``SHARD_ROWS`` rows is one shard and then trained by plain
mini-batch Adam. Weights do not depend on partitioning or on recomputed tasks:
a shard's rows are sorted before its seeded shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 65_536
#: partial sums of a round: this many tasks add up the shards' weights before the driver does
ADDERS = 16
#: epochs a single shard runs in one job; several shards meet after every epoch
EPOCHS_ALONE = 25
#: the rows are dealt to shards once; beyond this many, shards share a partition
MOST_PARTITIONS = 20_000
DECAY = (0.9, 0.999)
TINY = 1e-8


@dataclass(frozen=True)
class NetworkOptions:
    """Settings with the usual defaults of a multi-layer perceptron."""

    hidden: tuple[int, ...] = (100,)
    rate: float = 1e-3  # first learning rate
    l2: float = 1e-4
    batch: int = 200
    max_epochs: int = 500
    tolerance: float = 1e-4
    patience: int = 10
    early_stopping: bool = False  # on a held-back share instead of the training loss
    held_back: float = 0.1
    seed: int = 42


@dataclass
class Network:
    """Weights and offsets per layer; relu inside, softmax at the end."""

    weights: list[np.ndarray]
    offsets: list[np.ndarray]
    epochs: int = 0
    losses: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, sizes: list[int], seed: int) -> Network:
        """Uniform weights within sqrt(6 / (inputs + outputs))."""
        rng = np.random.default_rng(seed)
        bound = [math.sqrt(6.0 / max(a + b, 1)) for a, b in zip(sizes, sizes[1:], strict=False)]
        return cls(
            [rng.uniform(-r, r, (a, b)) for r, a, b in zip(bound, sizes, sizes[1:], strict=False)],
            [rng.uniform(-r, r, b) for r, b in zip(bound, sizes[1:], strict=True)],
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in [*self.weights, *self.offsets]])

    def filled(self, flat: np.ndarray) -> Network:
        """The same shape with other numbers."""
        parts, at = [], 0
        for x in [*self.weights, *self.offsets]:
            parts.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        return replace(self, weights=parts[: len(self.weights)], offsets=parts[len(self.weights) :])

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        """Inputs, hidden outputs and class shares."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.offsets, strict=True)):
            z = out[-1] @ w + b
            if i < len(self.weights) - 1:
                out.append(np.maximum(z, 0.0))
            else:
                z = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(z / z.sum(axis=1, keepdims=True))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1]

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean cross-entropy, without penalty."""
        p = self.probabilities(x)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean()) if len(y) else 0.0

    def gradient(self, x: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
        """(loss with penalty, its gradient) of one batch; the penalty is l2 / (2 rows) times the squared weights."""
        n, out = len(y), self.layers(x)
        p = out[-1][np.arange(n), y]
        loss = -np.log(np.maximum(p, 1e-300)).mean() + l2 / (2 * n) * sum(float((w * w).sum()) for w in self.weights)
        back = out[-1].copy()
        back[np.arange(n), y] -= 1.0
        back /= n
        by_weight: list[np.ndarray] = []
        by_offset: list[np.ndarray] = []
        for i in range(len(self.weights) - 1, -1, -1):
            by_weight.insert(0, out[i].T @ back + l2 / n * self.weights[i])
            by_offset.insert(0, back.sum(axis=0))
            if i:
                back = (back @ self.weights[i].T) * (out[i] > 0)
        return float(loss), np.concatenate([g.ravel() for g in [*by_weight, *by_offset]])


@dataclass
class Adam:
    """First and second moments and the number of steps taken."""

    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.steps += 1
        a, b = DECAY
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        lr = rate * math.sqrt(1 - b**self.steps) / (1 - a**self.steps)
        return -lr * self.first / (np.sqrt(self.second) + TINY)


class Patience:
    """Ends when a score has not fallen by the tolerance for more than ``patience`` epochs in a row."""

    def __init__(self, tolerance: float, patience: int) -> None:
        self.tolerance, self.patience = tolerance, patience
        self.best, self.waited = math.inf, 0

    def ended(self, score: float) -> bool:
        self.waited = self.waited + 1 if score > self.best - self.tolerance else 0
        self.best = min(self.best, score)
        return self.waited > self.patience


def run_epochs(net: Network, adam: Adam, x: np.ndarray, y: np.ndarray, o: NetworkOptions, first: int, epochs: int, shard: int) -> tuple[Network, list[tuple[float, np.ndarray]]]:
    """Trains in place of a shard; per epoch the mean loss and the weights after it."""
    size, done = max(1, min(o.batch, len(y))), []
    flat = net.flat()
    for e in range(first, first + epochs):
        order = np.random.default_rng([o.seed, shard, e]).permutation(len(y))
        total = 0.0
        for at in range(0, len(y), size):
            rows = order[at : at + size]
            loss, g = net.gradient(x[rows], y[rows], o.l2)
            total += loss * len(rows)
            flat = flat + adam.step(g, o.rate)
            net = net.filled(flat)
        done.append((total / len(y), flat))
    return net, done


RESULT = "place int, shard bigint, epoch int, n bigint, held bigint, loss double, held_loss double, steps double, flat array<double>, first array<double>, second array<double>"


def shard_work(net: Network, adam: Adam, o: NetworkOptions, first: int, epochs: int):
    """A task's part of a round: a row per epoch of its shard, moments with the last one."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        x, y = np.vstack(rows["v"].to_numpy()).astype(float), rows["label"].to_numpy(np.int64)
        held, shard = rows["held"].to_numpy(bool), int(rows["shard"].iloc[0])
        own = Adam(adam.first.copy(), adam.second.copy(), adam.steps)
        out = []
        if not held.all():
            _, done = run_epochs(net, own, x[~held], y[~held], o, first, epochs, shard)
        else:
            done = [(0.0, net.flat())] * epochs
        for i, (loss, flat) in enumerate(done):
            last = i == len(done) - 1
            out.append(
                (
                    shard % ADDERS, shard, first + i, int((~held).sum()), int(held.sum()), loss, net.filled(flat).loss(x[held], y[held]), float(own.steps),
                    flat.tolist(), own.first.tolist() if last else None, own.second.tolist() if last else None,
                )
            )
        return pd.DataFrame(out, columns=[p.split()[0] for p in RESULT.split(", ")])

    return work


def averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of weights and moments times rows, shard by shard, so that one array of each is held."""
    sums: dict[int, list] = {}
    for b in batches:
        for r in b.sort_values("shard").itertuples(index=False):
            s = sums.setdefault(r.epoch, [0, 0, 0.0, 0.0, 0.0, 0.0, None, None])
            for i, v in enumerate((r.n, r.held, r.loss * r.n, r.held_loss * r.held, r.steps * r.n, np.asarray(r.flat) * r.n)):
                s[i] = s[i] + v
            if r.first is not None:
                for i, v in ((6, r.first), (7, r.second)):
                    s[i] = np.asarray(v) * r.n if s[i] is None else s[i] + np.asarray(v) * r.n
    rows = [(0, 0, e, *s[:5], s[5].tolist(), None if s[6] is None else s[6].tolist(), None if s[7] is None else s[7].tolist()) for e, s in sums.items()]
    yield pd.DataFrame(rows, columns=[p.split()[0] for p in RESULT.split(", ")])


def fit_network(rows: DataFrame, n_features: int, n_classes: int, options: NetworkOptions, shard_rows: int = SHARD_ROWS) -> Network:
    """Trains on (key, label, v): a distinct key, class codes from 0 and feature arrays.

    Ends after ``max_epochs`` or when, for more than ``patience`` epochs, the
    training loss (with ``early_stopping``: the loss of a held-back share, whose best
    weights are then returned) has not fallen by ``tolerance``. Equal rows count
    each; an empty table is an error. A shard is one task's memory; fewer, larger
    ones send fewer weights about.
    """
    o = options
    n = rows.count()
    if not n:
        raise ValueError("a network needs at least one training row")
    shards = max(1, math.ceil(n / shard_rows))
    share = o.held_back if o.early_stopping else 0.0
    draw = F.pmod(F.xxhash64("key", F.lit(o.seed)), F.lit(1 << 20)) / float(1 << 20)
    ready = rows.select(
        "key", "label", "v", (draw < share).alias("held"),
        F.pmod(F.xxhash64("key", F.lit(o.seed + 1)), F.lit(shards)).alias("shard"),
    ).repartition(min(shards, MOST_PARTITIONS), "shard").persist()
    net = Network.start([n_features, *o.hidden, max(n_classes, 2)], o.seed)
    flat = net.flat()
    adam = Adam(np.zeros_like(flat), np.zeros_like(flat))
    watch, best = Patience(o.tolerance, o.patience), (math.inf, flat)
    epoch, step = 0, EPOCHS_ALONE if shards == 1 else 1
    try:
        while epoch < o.max_epochs:
            some = min(step, o.max_epochs - epoch)
            parts = ready.groupBy("shard").applyInPandas(shard_work(net, adam, o, epoch, some), RESULT)
            if shards > 1:  # a task's sums instead of every shard's weights
                parts = parts.repartition(min(ADDERS, shards), "place").mapInPandas(averaged, RESULT)
            got = pd.concat(averaged(iter([parts.toPandas()]))) if shards == 1 else parts.toPandas()
            total = got.groupby("epoch", sort=True)[["n", "held", "loss", "held_loss", "steps"]].sum()
            for e, t in total.iterrows():
                of_epoch = got[got["epoch"] == e]
                flat = np.sum([np.asarray(x) for x in of_epoch["flat"]], axis=0) / max(t["n"], 1)
                epoch = int(e) + 1
                score = t["held_loss"] / t["held"] if o.early_stopping and t["held"] else t["loss"] / max(t["n"], 1)
                net.losses.append(float(score))
                if score < best[0]:
                    best = (score, flat)
                if watch.ended(score):
                    return replace(net.filled(best[1] if o.early_stopping else flat), epochs=epoch)
            last = got[got["first"].notna()]
            mean = lambda x: np.sum([np.asarray(v) for v in last[x]], axis=0) / max(t["n"], 1)  # noqa: E731, B023
            net, adam = net.filled(flat), Adam(mean("first"), mean("second"), round(t["steps"] / max(t["n"], 1)))
    finally:
        ready.unpersist()
    return replace(net.filled(best[1] if o.early_stopping else flat), epochs=epoch)


__all__ = [x for x in dir() if not x.startswith("_") and x != "annotations"]
