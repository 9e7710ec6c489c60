"""Splits, folds, resampling and class balance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, hash_number
from tabwright.functions.ordering import join_keys, numbered_copies, ranked_by_hash

SEED = 42


def split_quotas(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """(label, n, quota): test rows per class by largest remainder.

    The quotas add up to ceil(test_size * rows); equal remainders go to the
    larger class, then the smaller label. Input and output have a row per class.
    """
    everything = Window.partitionBy()
    share = F.col("n") * F.lit(test_size)
    total = F.ceil(F.round(F.sum("n").over(everything) * F.lit(test_size), 9))
    base = counts.select(
        c(label),
        "n",
        F.floor(F.round(share, 9)).alias("whole"),
        F.round(share - F.floor(F.round(share, 9)), 9).alias("rest"),
        total.alias("total"),
    )
    left = F.col("total") - F.sum("whole").over(everything)
    place = F.row_number().over(Window.orderBy(F.desc("rest"), F.desc("n"), c(label)))
    return base.select(
        c(label), "n", (F.col("whole") + (place <= left).cast("long")).cast("long").alias("quota")
    )


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    test_size: float = 0.2,
    seed: int = SEED,
    check: bool = False,
) -> DataFrame:
    """Adds ``is_test``: class shares kept, seeded, independent of partitioning.

    ``check`` raises when a class has fewer than two rows.
    """
    counts = df.groupBy(c(label)).agg(F.count(F.lit(1)).alias("n"))
    if check:
        few = counts.agg(F.min("n")).first()[0]
        if few is None or few < 2:
            raise ValueError("every class needs at least two rows to split")
    quotas = split_quotas(counts, label, test_size).drop("n")
    ranked = ranked_by_hash(df, seed, [row_id], by=[label], out="__rank")
    return (
        join_keys(ranked, quotas, [label])
        .withColumn("is_test", F.col("__rank") <= F.col("quota"))
        .drop("__rank", "quota")
    )


def _with_class_sizes(df: DataFrame, label: str) -> DataFrame:
    """(label, n, least, most) with one row per class."""
    everything = Window.partitionBy()
    counts = df.groupBy(c(label)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        c(label),
        "n",
        F.min("n").over(everything).alias("least"),
        F.max("n").over(everything).alias("most"),
    )


def undersample(df: DataFrame, label: str, row_id: str, seed: int = SEED) -> DataFrame:
    """Every class cut to the smallest class size, without replacement."""
    sizes = _with_class_sizes(df, label).select(c(label), "least")
    ranked = ranked_by_hash(df, seed, [row_id], by=[label], out="__rank")
    return join_keys(ranked, sizes, [label]).where(F.col("__rank") <= F.col("least")).drop(
        "__rank", "least"
    )


def oversample(df: DataFrame, label: str, row_id: str, seed: int = SEED) -> DataFrame:
    """Every class raised to the largest: all rows kept, extras drawn with replacement.

    Adds ``draw``: 0 for an original row, 1.. for the extra draws of its class.
    """
    sizes = _with_class_sizes(df, label).select(
        c(label), "n", (F.col("most") - F.col("n")).alias("deficit")
    )
    draws = numbered_copies(sizes, "deficit", "draw").select(
        c(label),
        "draw",
        (hash_number(seed, c(label), F.col("draw")) % F.col("n") + 1).alias("__rank"),
    )
    ranked = ranked_by_hash(df, seed, [row_id], by=[label], out="__rank")
    extra = join_keys(draws, ranked, [label, "__rank"], "inner").drop("__rank")
    return df.withColumn("draw", F.lit(0).cast("long")).unionByName(
        extra.select(*df.columns, "draw")
    )


def stratified_folds(
    df: DataFrame,
    label: str,
    row_id: str,
    folds: int = 5,
    repeats: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``repeat`` and ``fold`` (both from 0): repeated stratified k folds."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = ranked_by_hash(many, seed, ["repeat", row_id], by=[label, "repeat"], out="__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__rank")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = SEED, out: str = "position") -> DataFrame:
    """Random permutation: a new position 1..n for every row."""
    return ranked_by_hash(df, seed, list(key), out=out)


def balance_deficit(df: DataFrame, label: str) -> DataFrame:
    """(label, n, deficit, is_balanced): rows each class lacks to reach the largest."""
    sizes = _with_class_sizes(df, label)
    return sizes.select(
        c(label),
        "n",
        (F.col("most") - F.col("n")).alias("deficit"),
        (F.col("most") == F.col("least")).alias("is_balanced"),
    )


def balanced_allocation(df: DataFrame, label: str, size: int | None = None, multiclass: bool | None = None) -> DataFrame:
    """(label, n_rows): rows per class for a fresh balanced table of ``size`` rows.

    Two classes: floor(N/2) for the larger label (true), the rest for the other.
    More classes: int(N/k) each.
    """
    counts = df.groupBy(c(label)).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything) if size is None else F.lit(size)
    k = F.count(F.lit(1)).over(everything)
    binary = (k <= 2) if multiclass is None else F.lit(not multiclass)
    half = F.floor(total / 2)
    is_true = F.row_number().over(Window.orderBy(c(label).desc())) == 1
    return counts.select(
        c(label),
        F.when(binary, F.when(is_true, half).otherwise(total - half))
        .otherwise(F.floor(total / k))
        .cast("long")
        .alias("n_rows"),
    )


def ceil_share(n: int, share: float) -> int:
    """ceil(n * share) without floating-point overshoot."""
    return math.ceil(round(n * share, 9))
