"""Column profiling: types, missing flags, class values and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.exprs import FALSE_WORDS, TRUE_WORDS, c, null_if_token, parse_number, quoted
from tabwright.functions.ordering import join_keys

PROFILE_SCHEMA = "column string, data_type string, has_missing boolean, all_null boolean"


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    data_type: str
    has_missing: bool
    all_null: bool


def null_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing-value texts (and whole-cell ``-``) of text columns become NULL."""
    todo = set(columns or df.columns)
    return df.select(
        *[
            null_if_token(c(f.name)).alias(f.name)
            if f.name in todo and isinstance(f.dataType, T.StringType)
            else c(f.name)
            for f in df.schema.fields
        ]
    )


def _clean(field: T.StructField) -> Column:
    col = c(field.name)
    if isinstance(field.dataType, T.StringType):
        return null_if_token(col)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def _all(test: Column) -> Column:
    """True when the test holds for every non-null value (also for none)."""
    return F.coalesce(F.bool_and(test), F.lit(True))


def infer_column_types(df: DataFrame) -> list[ColumnProfile]:
    """float / integer / bool / string per column, from one aggregate over the table."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        v = _clean(f)
        aggs.append(F.count(v).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            text = F.trim(v)
            num = parse_number(text)
            low = F.lower(text)
            facts = {
                "num": v.isNull() | num.isNotNull(),
                "lit": v.isNull() | text.rlike(r"^[+-]?[0-9]+$"),
                "int": v.isNull() | (num % 1 == 0),
                "bit": v.isNull() | num.isin(0.0, 1.0),
                "yn": v.isNull() | low.isin(TRUE_WORDS[0], FALSE_WORDS[0]),
                "tf": v.isNull() | low.isin(TRUE_WORDS[1], FALSE_WORDS[1]),
            }
        elif isinstance(f.dataType, T.NumericType):
            num = v.cast("double")
            facts = {"int": num % 1 == 0, "bit": num.isin(0.0, 1.0)}
        else:
            facts = {}
        aggs += [_all(F.coalesce(t, F.lit(False)) | v.isNull()).alias(f"{k}{i}") for k, t in facts.items()]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()

    def kind(i: int, f: T.StructField) -> str:
        missing = row[f"n{i}"] < row["rows"]
        fact = lambda k: bool(row[f"{k}{i}"])
        if isinstance(f.dataType, T.BooleanType):
            return "bool"
        text = isinstance(f.dataType, T.StringType)
        if not text and not isinstance(f.dataType, T.NumericType):
            return "string"
        if text and not fact("num"):
            return "bool" if fact("yn") or fact("tf") else "string"
        whole = fact("lit") if text else isinstance(f.dataType, T.IntegralType)
        # a column of decimals without gaps stays float even when all are whole
        if whole or (missing and fact("int")):
            return "bool" if fact("bit") else "integer"
        return "float"

    return [
        ColumnProfile(f.name, kind(i, f), row[f"n{i}"] < row["rows"], row[f"n{i}"] == 0)
        for i, f in enumerate(df.schema.fields)
    ]


def profile_table(df: DataFrame) -> DataFrame:
    """``infer_column_types`` as a (column, data_type, has_missing, all_null) table."""
    rows = [(p.column, p.data_type, p.has_missing, p.all_null) for p in infer_column_types(df)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def missing_flags(df: DataFrame) -> DataFrame:
    """(column, has_missing) for every column, in one aggregate."""
    flags = df.agg(
        *[
            F.coalesce(F.max(_clean(f).isNull()), F.lit(False)).alias(f.name)
            for f in df.schema.fields
        ]
    )
    return unpivot_all(flags, "column", "has_missing")


def unpivot_all(df: DataFrame, name: str, value: str, ids: list[str] | None = None) -> DataFrame:
    ids = ids or []
    rest = [x for x in df.columns if x not in ids]
    return df.unpivot([c(x) for x in ids], [c(x) for x in rest], name, value)


def missing_cells(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, column) of every null cell."""
    flags = df.select(
        c(row_id),
        F.filter(
            F.array(
                *[
                    F.when(_clean(f).isNull(), F.lit(f.name))
                    for f in df.schema.fields
                    if f.name != row_id
                ]
            ),
            lambda x: x.isNotNull(),
        ).alias("__cols"),
    )
    return flags.select(c(row_id), F.explode("__cols").alias("column"))


def class_values(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Distinct non-null labels as text, with the smallest row id that shows each."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found in dataset")
    return (
        df.where(c(column).isNotNull())
        .groupBy(c(column))
        .agg(F.min(c(row_id)).alias("first_row"))
        .select(c(column).cast("string").alias("class_value"), "first_row")
    )


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per class; a NULL label is a class of its own."""
    return df.groupBy(c(column).alias("class_value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_with_null(col: Column) -> Column:
    """Aggregate: distinct values, NULL counted as one."""
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull()).cast("long"), F.lit(0))


def cardinality_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct, n_rows, ratio); NULL counts as a value.

    Each column is reduced to its distinct values by a two-stage group-by, so
    no task holds a column's whole value set.
    """
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value"))
                    for x in columns
                ]
            )
        ).alias("p")
    ).select("p.*")
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_rows"),
        (F.count(F.lit(1)) / F.sum("n")).alias("ratio"),
    )


def class_kind(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """``binary`` for at most two distinct labels, else ``multiclass``."""
    by = by or []
    per = df.groupBy(*[c(b) for b in by], c(label)).agg(F.lit(1).alias("one"))
    return per.groupBy(*[c(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.when(F.count(F.lit(1)) <= 2, "binary").otherwise("multiclass").alias("kind"),
    )


__all__ = [
    "ColumnProfile",
    "cardinality_ratio",
    "class_counts",
    "class_kind",
    "class_values",
    "distinct_with_null",
    "infer_column_types",
    "join_keys",
    "missing_cells",
    "missing_flags",
    "null_tokens",
    "profile_table",
    "quoted",
    "unpivot_all",
]
