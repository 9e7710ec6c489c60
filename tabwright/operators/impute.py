"""Round-robin regression imputation from second-moment aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.operators.linalg import moment_matrix
from tabwright.session import cut


def bayesian_ridge(moments: np.ndarray, y: int, max_iter: int = 300, tol: float = 1e-3):
    """(intercept, weights) of evidence-maximised ridge regression (MacKay 1992).

    ``moments`` is Σ[1,x]ᵀ[1,x]; column ``y`` (0-based among x) is the target and
    all others are inputs. Only the moments are needed, never the rows.
    """
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] - n * np.outer(mean, mean)
    keep = [i for i in range(len(mean)) if i != y]
    gram, cross, total = cov[np.ix_(keep, keep)], cov[keep, y], cov[y, y]
    eig, vec = np.linalg.eigh(gram)
    eig = np.clip(eig, 0.0, None)
    proj = vec.T @ cross
    noise = 1.0 / (total / n + np.finfo(float).eps)
    weight_prec = 1.0
    prior = 1e-6  # flat Gamma priors on both precisions
    old = None

    def solve() -> np.ndarray:
        return vec @ (proj / (eig + weight_prec / noise))

    for _ in range(max_iter):
        w = solve()
        error = max(total - 2 * w @ cross + w @ gram @ w, 0.0)
        active = np.sum(noise * eig / (weight_prec + noise * eig))
        weight_prec = (active + 2 * prior) / (w @ w + 2 * prior)
        noise = (n - active + 2 * prior) / (error + 2 * prior)
        if old is not None and np.sum(np.abs(old - w)) < tol:
            break
        old = w
    w = solve()
    return float(mean[y] - mean[keep] @ w), dict(zip(keep, w, strict=True))


def impute_iterative(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str,
    only: Sequence[str] | None = None,
    max_iter: int = 10,
    tol: float = 1e-3,
) -> DataFrame:
    """Fill numeric gaps by regressing each gappy column on all others, round after round.

    Starts from column means, visits columns by rising number of gaps, stops
    after ``max_iter`` rounds or when no fill moves by more than ``tol`` times
    the largest observed value. Only ``only`` columns (default all) keep their
    fills; elsewhere the gaps come back. Each step is one aggregate over the
    table; the solved matrix has one row per column.
    """
    from pyspark.sql import types as T

    text = [x for x in columns if isinstance(df.schema[x].dataType, T.StringType)]
    if text:
        raise ValueError(f"Cannot synthetically fill beside text columns: {', '.join(text)}")
    only = list(columns) if only is None else list(only)
    vals = {x: c(x).cast("double") for x in columns}
    facts = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(vals.values())],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(vals.values())],
        *[F.max(F.abs(v)).alias(f"a{i}") for i, v in enumerate(vals.values())],
        F.count(F.lit(1)).alias("rows"),
    ).first()
    k = len(columns)
    if any(facts[f"n{i}"] == 0 for i in range(k)):
        raise ValueError("Cannot synthetically fill columns with no real values.")
    gappy = [i for i in range(k) if facts[f"n{i}"] < facts["rows"]]
    if not gappy:
        return df
    gappy.sort(key=lambda i: facts["rows"] - facts[f"n{i}"])
    limit = tol * max(facts[f"a{i}"] for i in range(k))

    # v<i>: current value; g<i>: was a gap
    work = df.select(
        c(row_id).alias("__id"),
        *[F.coalesce(v, F.lit(facts[f"m{i}"])).alias(f"v{i}") for i, v in enumerate(vals.values())],
        *[c(columns[i]).isNull().alias(f"g{i}") for i in gappy],
    )
    names = [f"v{i}" for i in range(k)]
    for _ in range(max_iter):
        before = work
        step = work.select("*", *[F.col(f"v{i}").alias(f"o{i}") for i in gappy])
        for i in gappy:
            moments = moment_matrix(step.where(~F.col(f"g{i}")), names)
            base, weights = bayesian_ridge(moments, i)
            guess = F.lit(base)
            for j, w in weights.items():
                guess = guess + F.lit(float(w)) * F.col(f"v{j}")
            step = step.withColumn(f"v{i}", F.when(F.col(f"g{i}"), guess).otherwise(F.col(f"v{i}")))
        work = cut(step)
        moved = work.agg(
            F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"v{i}") - F.col(f"o{i}")) for i in gappy]))
        ).first()[0]
        work = work.drop(*[f"o{i}" for i in gappy])
        del before
        if moved < limit:
            break
    fills = work.select(
        F.col("__id").alias(row_id),
        *[F.col(f"v{i}").alias(f"__f{i}") for i in gappy if columns[i] in only],
    )
    joined = df.join(fills, row_id, "left")
    for i in gappy:
        if columns[i] in only:
            joined = joined.withColumn(columns[i], F.coalesce(vals[columns[i]], F.col(f"__f{i}")))
    return joined.select(*[c(x) for x in df.columns])
