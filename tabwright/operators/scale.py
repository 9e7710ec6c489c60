"""Scalers, feature vectors and two-component projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c


@dataclass(frozen=True)
class Scaler:
    """(x - shift) / width per column; width 0 means a constant column, scaled to 0."""

    kind: str
    columns: tuple[str, ...]
    shift: tuple[float, ...]
    width: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {
            x: ((c(x).cast("double") - F.lit(s)) / F.lit(w)) if w else (c(x).cast("double") * 0.0)
            for x, s, w in zip(self.columns, self.shift, self.width, strict=True)
        }
        return df.withColumns(new)


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "minmax") -> Scaler:
    """One aggregate over the training table; ``minmax`` or ``standard`` (population std)."""
    v = [c(x).cast("double") for x in columns]
    if kind == "minmax":
        aggs = [a for i, x in enumerate(v) for a in (F.min(x).alias(f"s{i}"), F.max(x).alias(f"w{i}"))]
    elif kind == "standard":
        aggs = [
            a
            for i, x in enumerate(v)
            for a in (F.avg(x).alias(f"s{i}"), F.stddev_pop(x).alias(f"w{i}"))
        ]
    else:
        raise ValueError(f"unknown scaler: {kind}")
    row = df.agg(*aggs).first()
    shift, width = [], []
    for i in range(len(v)):
        s, w = row[f"s{i}"] or 0.0, row[f"w{i}"] or 0.0
        w = w - s if kind == "minmax" else w
        # rounding noise of a constant column is not spread
        if kind == "standard" and w <= 1e-12 * max(1.0, abs(s)):
            w = 0.0
        shift.append(float(s))
        width.append(float(w))
    return Scaler(kind, tuple(columns), tuple(shift), tuple(width))


def minmax_scale(train: DataFrame, columns: Sequence[str], apply_to: DataFrame | None = None) -> DataFrame:
    return fit_scaler(train, columns, "minmax").transform(train if apply_to is None else apply_to)


def standard_scale(train: DataFrame, columns: Sequence[str], apply_to: DataFrame | None = None) -> DataFrame:
    return fit_scaler(train, columns, "standard").transform(train if apply_to is None else apply_to)


def assemble_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric and boolean columns to one dense vector in the given order."""
    array = F.array(*[c(x).cast("double") for x in columns])
    return df.withColumn(out, array_to_vector(array))


def assembler(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


def pca_2d(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First two principal coordinates per row and the variance ratio of each.

    The largest loading of a component is made positive, so signs are stable.
    """
    vec = assemble_features(df.dropna(subset=list(columns)), columns, "__v")
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(vec)
    load = model.pc.toArray()
    ratio = model.explainedVariance.toArray()
    sign = [1.0 if load[np.argmax(np.abs(load[:, i])), i] >= 0 else -1.0 for i in range(2)]
    # the projection does not centre: take the projected mean off
    means = df.dropna(subset=list(columns)).agg(
        *[F.avg(c(x).cast("double")).alias(f"m{i}") for i, x in enumerate(columns)]
    ).first()
    centre = np.array([means[f"m{i}"] for i in range(len(columns))]) @ load
    at = vector_to_array("__p")
    return model.transform(vec).select(
        *[c(x) for x in keep],
        *[
            ((at[i] - F.lit(float(centre[i]))) * F.lit(sign[i])).alias(f"pc{i + 1}")
            for i in range(2)
        ],
        *[F.lit(float(ratio[i])).alias(f"ratio{i + 1}") for i in range(2)],
    )
