"""Cleaning, casting, encoding and label mapping of one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.exprs import c, parse_boolean_text, parse_number, plain_number_text
from tabwright.functions.ordering import join_keys
from tabwright.operators.impute import impute_iterative
from tabwright.operators.profile import class_kind

ONE_HOT_RATIO = 0.1
TOO_MANY = (
    "Column {0} has too many categories to be one-hot encoded. "
    "Drop this column or encode as integer instead."
)


class ColumnChangeError(ValueError):
    """A requested column change cannot be applied."""


@dataclass(frozen=True)
class ColumnSpec:
    """What to do with one column."""

    column: str
    data_type: str = "string"  # float, integer, bool, categorical, string
    checked: bool = True
    missing: str = ""  # "", drop, constant, synthetic
    fill_value: str = ""
    is_class: bool = False
    categories: tuple[str, ...] = field(default=())


def spec_order(spec: Sequence[ColumnSpec]) -> list[ColumnSpec]:
    """Categorical columns first, so that numeric imputation sees encoded data."""
    return sorted(spec, key=lambda s: s.data_type != "categorical")


def select_columns(df: DataFrame, spec: Sequence[ColumnSpec]) -> DataFrame:
    """Drop unchecked columns; a checked column the table lacks is an error."""
    for s in spec:
        if s.checked and s.column not in df.columns and s.column.lower() != "index":
            raise ColumnChangeError(
                f"Column {s.column} cannot be included because it was not in the original dataset."
            )
    return df.drop(*[s.column for s in spec if not s.checked])


def fill_constant(df: DataFrame, column: str, value: str) -> DataFrame:
    """NULL becomes a user constant, cast to the column's type."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        probe = df.sparkSession.range(1).select(F.lit(value).try_cast(kind).alias("v")).first()
        if probe["v"] is None:
            raise ColumnChangeError(f"Cannot fill column {column} with value {value}")
    return df.withColumn(column, F.coalesce(c(column), F.lit(value).cast(kind)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(c(column).isNotNull())


def column_mode(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent non-null value, smallest on ties."""
    counts = df.where(c(column).isNotNull()).groupBy(c(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return best.select(F.col("b.value").alias("value"), (-F.col("b.n")).alias("n"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """NULL becomes the column's mode."""
    row = column_mode(df, column).first()
    if row["value"] is None:
        raise ColumnChangeError("Cannot synthetically fill columns with no real values.")
    return df.withColumn(
        column, F.coalesce(c(column), F.lit(row["value"]).cast(df.schema[column].dataType))
    )


def _cast_or_error(df: DataFrame, column: str, new: Column, kind: str) -> DataFrame:
    """Replace a column; a value the cast loses fails the job with its column named."""
    bad = c(column).isNotNull() & new.isNull()
    message = F.lit(f"Cannot convert column {column} to type {kind}")
    return df.withColumn(column, F.when(bad, F.raise_error(message)).otherwise(new))


def cast_float(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return df.withColumn(column, c(column).cast("double"))
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df.withColumn(column, c(column).cast("double"))
    return _cast_or_error(df, column, parse_number(c(column)), "float")


def boolean_of(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return c(column)
    if isinstance(kind, T.NumericType):
        return c(column) != 0
    number = parse_number(c(column))
    return F.coalesce(parse_boolean_text(c(column)).cast("boolean"), number != 0)


def cast_bool(df: DataFrame, column: str) -> DataFrame:
    """Text by yes/no and true/false, numbers by non-zero; NULL is an error."""
    new = boolean_of(df, column)
    message = F.lit(f"Cannot convert column {column} to type bool")
    return df.withColumn(column, F.when(new.isNull(), F.raise_error(message)).otherwise(new))


def cast_integer(df: DataFrame, column: str) -> DataFrame:
    """Round half to even, then integer; NULL is an error."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        new = c(column).cast("long")
    elif isinstance(kind, T.IntegralType):
        new = c(column).cast("long")
    else:
        text = isinstance(kind, T.StringType)
        number = parse_number(c(column)) if text else c(column).cast("double")
        new = F.bround(number, 0).try_cast("long")
    message = F.lit(f"Cannot convert column {column} to type integer")
    return df.withColumn(column, F.when(new.isNull(), F.raise_error(message)).otherwise(new))


def record_categories(df: DataFrame, column: str) -> DataFrame:
    """One row: the sorted distinct non-null values of a column as text."""
    return (
        df.where(c(column).isNotNull())
        .select(c(column).cast("string").alias("v"))
        .distinct()
        .agg(F.sort_array(F.collect_list("v")).alias("categories"))
        .select(F.lit(column).alias("column"), "categories")
    )


def category_values(df: DataFrame, column: str, gate: bool = True) -> list[str]:
    """Sorted values to encode, after the cardinality gate (distinct/rows <= 0.1).

    One aggregate answers the gate; the values that pass it become columns and so
    come to the driver with the schema. There is no other limit on their number.
    """
    counts = df.groupBy(c(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n")).first()
    if not size["n"]:
        raise ColumnChangeError(
            "All rows dropped due to missing values. Choose alternate fill method."
        )
    if gate and size["d"] / size["n"] > ONE_HOT_RATIO:
        raise ColumnChangeError(TOO_MANY.format(column))
    rows = counts.where(F.col("value").isNotNull()).select("value").collect()
    return [str(r["value"]) for r in sorted(rows, key=lambda r: r["value"])]


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """Boolean column ``<column>_<value>`` per non-null value; source dropped; NULL all false."""
    values = category_values(df, column) if values is None else list(values)
    text = c(column).cast("string")
    flags = [
        F.coalesce(text == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in values
    ]
    return df.select(*[c(x) for x in df.columns if x != column], *flags)


def validate_class(df: DataFrame, column: str) -> None:
    """A class column needs at least two distinct values (NULL counts)."""
    if class_kind(df, column).first()["n_classes"] < 2:
        raise ColumnChangeError("The class column must have more than one class.")


def use_index_column(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A column called index becomes the row id if unique and complete; otherwise it is dropped."""
    found = [x for x in df.columns if x.lower() == "index"]
    if not found:
        return df
    name = found[0]
    per = df.groupBy(c(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    facts = per.agg(
        F.max("n").alias("most"), F.coalesce(F.max(F.col("v").isNull()), F.lit(False)).alias("gap")
    ).first()
    base = df.drop(*found[1:])
    if facts["most"] == 1 and not facts["gap"]:
        return base.drop(row_id).withColumnRenamed(name, row_id)
    return base.drop(name)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ColumnChangeError(
            "All rows dropped due to missing values. Choose alternate fill method."
        )
    return df


def map_class_labels(df: DataFrame, column: str, mapping: dict[str, int]) -> DataFrame:
    """``<c>`` moves to ``<c>_mapping`` as text; a new integer ``<c>`` comes from the map."""
    original = f"{column}_mapping"
    if original in df.columns:
        n = 0
        while f"{column}_mapping_feature_{n}" in df.columns:
            n += 1
        df = df.withColumnRenamed(original, f"{column}_mapping_feature_{n}")
    df = df.withColumnRenamed(column, original)
    df = df.withColumn(original, plain_number_text(c(original)))
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(column, F.try_element_at(F.create_map(*pairs), c(original)).cast("int"))


def default_label_map(values: DataFrame) -> DataFrame:
    """(class_value, code) from ``class_values`` output.

    Two classes: yes/true is 1 and the other 0, otherwise first seen is 0. More
    classes: 0.. in first-seen order. The input has one row per class.
    """
    from pyspark.sql import Window

    everything = Window.partitionBy()
    seq = Window.orderBy("first_row")
    yes = F.lower("class_value").isin("yes", "true")
    return values.select(
        "class_value",
        F.when(
            (F.count(F.lit(1)).over(everything) == 2) & F.max(yes).over(everything),
            # the earliest yes/true takes 1
            (
                F.col("first_row") == F.min(F.when(yes, F.col("first_row"))).over(everything)
            ).cast("int"),
        )
        .otherwise(F.row_number().over(seq) - 1)
        .cast("long")
        .alias("code"),
    )


def label_dictionary(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Distinct (code, label) pairs and the table without its mapping column."""
    original = f"{column}_mapping"
    pairs = df.select(c(column).alias("code"), c(original).alias("label")).distinct()
    return pairs, df.drop(original)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): codes 0.. by sorted label. One row per class."""
    from pyspark.sql import Window

    return df.select(c(column).alias("label")).where(c(column).isNotNull()).distinct().select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("code")
    )


def encode_labels(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace labels by codes fitted on training data; an unseen label is an error."""
    codes = label_codes(df, column) if codes is None else codes
    look = codes.select(F.col("label").alias(column), F.col("code").alias("__code"))
    joined = df.join(look, column, "left")
    message = F.concat(F.lit("label not seen in training: "), c(column).cast("string"))
    return joined.withColumn(
        column,
        F.when(c(column).isNotNull() & F.col("__code").isNull(), F.raise_error(message)).otherwise(
            F.col("__code")
        ),
    ).select(*df.columns)


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def feature_columns(df: DataFrame, class_column: str | None, row_id: str = "row_id") -> list[str]:
    return [x for x in df.columns if x not in {class_column, row_id}]


def column_key(columns: Sequence[str]) -> str:
    """Column list as one text, dashes between names."""
    return "[" + "-".join(x.replace(" ", "").replace("'", "") for x in columns) + "]"


def conform_testset(
    train_columns: Sequence[str],
    test: DataFrame,
    class_column: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Index columns dropped, columns checked and put in training order.

    The class column, if present, and ``keep`` columns (a row id) come last.
    """
    test = test.drop("index", "Index")
    want = [x for x in train_columns if x != class_column]
    have = [x for x in test.columns if x != class_column and x not in keep]
    missing = sorted(set(want) - set(have))
    extra = sorted(set(have) - set(want))
    if missing or extra:
        parts = []
        if missing:
            parts.append(f"Test set is missing columns: {', '.join(missing)}")
        if extra:
            parts.append(f"Test set has unexpected columns: {', '.join(extra)}")
        if len(have) != len(want):
            parts.append(f"test set has {len(have)} features, training had {len(want)}")
        raise ColumnChangeError("; ".join(parts))
    tail = [x for x in (class_column, *keep) if x and x in test.columns]
    return test.select(*[c(x) for x in [*want, *tail]])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to number; unparseable text becomes NULL."""
    return df.withColumns(
        {
            x: parse_number(c(x))
            if isinstance(df.schema[x].dataType, T.StringType)
            else c(x).cast("double")
            for x in columns
        }
    )


OPTION_SCHEMA = "name string, kind string, bool_value boolean, long_value bigint, double_value double, text_value string"


def coerce_options(options: DataFrame, known: Sequence[str] | None = None) -> DataFrame:
    """Option rows (name, value text) with the value typed; unknown names dropped."""
    v = F.col("value")
    is_bool = v.isin("True", "False")
    wants_float = v.contains(".") | F.lower(v).contains("e")
    as_float = F.when(~is_bool & wants_float, parse_number(v))
    as_long = F.when(~is_bool & ~wants_float, F.trim(v).try_cast("long"))
    kind = (
        F.when(is_bool, "bool")
        .when(as_float.isNotNull(), "float")
        .when(as_long.isNotNull(), "int")
        .otherwise("text")
    )
    out = options if known is None else options.where(F.col("name").isin(*known))
    return out.withColumns(
        {
            "kind": kind,
            "bool_value": F.when(is_bool, v == "True"),
            "long_value": as_long,
            "double_value": as_float,
            "text_value": F.when(kind == "text", v),
        }
    ).drop("value")


def option_lists(options: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Repeated list options (arrays or single values) collected into one flat list."""
    keys = [c(b) for b in by]
    return options.groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct(c(order), F.col("values")))),
                lambda s: s["values"],
            )
        ).alias("values")
    )


def apply_spec(
    df: DataFrame, spec: Sequence[ColumnSpec], row_id: str = "row_id"
) -> tuple[DataFrame, list[ColumnSpec]]:
    """Apply a whole column spec; returns the table and the spec with categories filled in."""
    df = select_columns(df, spec)
    done: list[ColumnSpec] = []
    for s in spec_order(spec):
        if not s.checked or s.column not in df.columns or s.column.lower() == "index":
            done.append(s)
            continue
        if s.missing == "constant":
            df = fill_constant(df, s.column, s.fill_value)
        elif s.missing == "drop":
            df = drop_missing(df, s.column)
        elif s.missing == "synthetic":
            if s.data_type == "categorical":
                df = impute_mode(df, s.column)
            else:
                others = [x for x in df.columns if x != row_id]
                df = impute_iterative(df, others, row_id, only=[s.column])
        if s.data_type == "float":
            df = cast_float(df, s.column)
        elif s.data_type == "bool":
            df = cast_bool(df, s.column)
        elif s.data_type == "integer":
            df = cast_integer(df, s.column)
        elif not s.is_class:
            values = category_values(df, s.column)
            df = one_hot(df, s.column, values)
            s = replace(s, categories=tuple(values))
        elif f"{s.column}_mapping" in df.columns:
            cats = record_categories(df, f"{s.column}_mapping").first()["categories"]
            s = replace(s, categories=tuple(cats))
        if s.is_class:
            validate_class(df, s.column)
        done.append(s)
    return require_rows(use_index_column(df, row_id)), done


__all__ = [x for x in dir() if not x.startswith("_") and x not in {"annotations", "join_keys"}]
