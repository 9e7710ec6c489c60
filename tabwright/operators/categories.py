"""Columns of very many categories: a value dictionary as a table, codes and sparse vectors.

``clean.one_hot`` makes a column per value, which fits a few hundred values. Here
the values stay a table however many they are: they are ranked by frequency
without one big sort, joined back as codes, and a row's one-hot form is a sparse
vector with a single entry. Nothing but the number of values comes to the driver.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.exprs import c
from tabwright.functions.ordering import ranked_by_hash
from tabwright.session import write_through

#: Codes below this are joined by broadcast, if their text is short: the most frequent values are the hot keys.
HOT_CODES, HOT_CHARS = 256, 1000
#: Rows without a value to look up spread over this many join keys.
SPREAD = 1 << 16
MOST_CODES = (1 << 31) - 1  # a vector's size is an int


def category_dictionary(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """(value, n, code): every distinct non-null value as text, its rows, and its rank by ``n`` from 0.

    Equal counts go by a seeded hash of the value, so codes do not depend on
    partitioning. The table is written once to the shared folder. Empty text is a
    value; an empty or all-null column gives no rows.

    Ranks take no total sort: values of one count are ranked by hash buckets, and
    the counts themselves, of which N rows have at most sqrt(2 N) different ones,
    are summed from the largest down.
    """
    counts = (
        df.where(c(column).isNotNull())
        .groupBy(c(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = write_through(counts, "category-counts")
    inside = ranked_by_hash(counts, seed, ["value"], ["n"], "__place")
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("values"))
    steps = steps.select("n", F.coalesce(F.sum("values").over(above), F.lit(0)).alias("__above"))
    ranked = inside.join(steps, "n").select("value", "n", (F.col("__above") + F.col("__place") - 1).alias("code"))
    return write_through(ranked, "categories")


def with_codes(df: DataFrame, column: str, dictionary: DataFrame, row_id: str, out: str | None = None) -> DataFrame:
    """Adds ``<column>_code``: the value's code, NULL for NULL and for values the dictionary lacks.

    The most frequent values, which may hold most rows, are looked up by
    broadcast; only the other rows need their value's partition of the
    dictionary, and rows with nothing to look up are spread by ``row_id``.
    """
    out = out or f"{column}_code"
    short = (F.col("code") < HOT_CODES) & (F.length("value") <= HOT_CHARS)
    hot = dictionary.where(short).select(F.col("value").alias("__hot_value"), F.col("code").alias("__hot"))
    rest = dictionary.where(~short).select(F.col("value").alias("__value"), F.col("code").alias("__code"), F.lit(0).alias("__zero"))
    text = c(column).cast("string")
    first = df.join(F.broadcast(hot), text == F.col("__hot_value"), "left").drop("__hot_value")
    open_ = F.col("__hot").isNull() & c(column).isNotNull()
    first = first.withColumns(
        {
            "__want": F.when(open_, text),
            "__slot": F.when(open_, 0).otherwise(1 + F.pmod(F.xxhash64(c(row_id)), F.lit(SPREAD))).cast("int"),
        }
    )
    both = (F.col("__want") == F.col("__value")) & (F.col("__slot") == F.col("__zero"))
    found = first.join(rest, both, "left")
    return found.select(*[c(x) for x in df.columns if x != out], F.coalesce("__hot", "__code").alias(out))


def category_count(dictionary: DataFrame) -> int:
    """Number of values; more than a vector can index is an error."""
    n = dictionary.count()
    if n > MOST_CODES:
        raise ValueError(f"{n} categories are more than a vector can hold; use the codes")
    return n


def with_vectors(df: DataFrame, code: str, size: int, out: str) -> DataFrame:
    """Adds a sparse one-hot vector of ``size`` for a code column; a NULL code gives the zero vector.

    The struct a vector is stored as becomes a vector through its JSON form, in the JVM.
    """
    known = c(code).isNotNull()
    entry = lambda value, kind: F.when(known, F.array(value)).otherwise(F.array().cast(f"array<{kind}>"))
    stored = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        entry(c(code).cast("int"), "int").alias("indices"),
        entry(F.lit(1.0), "double").alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    kept = [c(x) for x in df.columns if x != out]
    return df.select(*kept, F.from_json(F.to_json(F.struct(stored.alias("v"))), schema)["v"].alias(out))


def one_hot_sparse(
    df: DataFrame, column: str, row_id: str, dictionary: DataFrame | None = None, out: str | None = None
) -> DataFrame:
    """The sparse form of ``one_hot``: the column becomes one vector ``<column>_vector``.

    Pass the training table's dictionary to encode other rows alike; values it
    lacks, like NULL, give the zero vector, as all flags of the narrow form are false.
    """
    dictionary = category_dictionary(df, column) if dictionary is None else dictionary
    out = out or f"{column}_vector"
    coded = with_codes(df, column, dictionary, row_id, "__category_code")
    return with_vectors(coded, "__category_code", category_count(dictionary), out).drop("__category_code", column)


__all__ = [x for x in dir() if not x.startswith("_") and x != "annotations"]
