"""Pure column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "missing" in a CSV (the usual reader
# defaults, plus a lone dash).
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
    "-",
)

# Texts read as booleans.
TRUE_WORDS = ("yes", "true")
FALSE_WORDS = ("no", "false")


def quoted(name: str) -> str:
    """Column name safe for dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(quoted(name))


def null_if_token(col: Column) -> Column:
    """Missing-value texts become NULL; other text keeps its spelling."""
    return F.when(~F.trim(col).isin(*NULL_TOKENS), col)


def parse_boolean_text(col: Column) -> Column:
    """yes/true -> 1, no/false -> 0, case-insensitive; anything else NULL."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low.isin(*TRUE_WORDS), F.lit(1)).when(low.isin(*FALSE_WORDS), F.lit(0))


def parse_number(col: Column) -> Column:
    """Text to double, NULL if it is no number.

    The cast alone would also take Java's ``1d`` and ``2.5f``.
    """
    return F.when(~col.rlike(r"[0-9.][dDfF]\s*$"), col.try_cast("double"))


def plain_number_text(col: Column) -> Column:
    """Text of a number without a trailing ``.0``."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def order_key(seed: int, *cols: Column) -> Column:
    """Seeded pseudo-random ordering text: stable under repartitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") for x in cols]))


def hash_number(seed: int, *cols: Column) -> Column:
    """Seeded 60-bit non-negative integer drawn from the ordering text."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 15), 16, 10).cast("long")


def mean_error_text(mean: Column, error: Column, digits: int = 3) -> Column:
    """``m ± e`` with trailing zeros dropped; NULL stays NULL."""
    return F.concat(
        F.round(mean, digits).cast("string"), F.lit(" ± "), F.round(error, digits).cast("string")
    )


def parse_mean(col: Column) -> Column:
    """Mean of an ``m ± e`` text; ``N/A`` counts as 0."""
    return F.when(col == "N/A", F.lit(0.0)).otherwise(
        F.split(col, " ± ").getItem(0).try_cast("double")
    )


def parse_error(col: Column) -> Column:
    """Error of an ``m ± e`` text; ``N/A`` counts as 0."""
    return F.when(col == "N/A", F.lit(0.0)).otherwise(
        F.split(col, " ± ").getItem(1).try_cast("double")
    )


def sanitize_name(col: Column, limit: int = 100) -> Column:
    """Dataset name from a file name: no extension, spaces to ``_``, safe characters only."""
    stem = F.regexp_replace(col, r"\.[^.]*$", "")
    safe = F.regexp_replace(F.replace(stem, F.lit(" "), F.lit("_")), r"[^a-zA-Z0-9_\-]", "")
    return F.substring(safe, 1, limit)


def signed_label(col: Column, digits: int = 3) -> Column:
    """Number text with an explicit sign, as printed beside bars."""
    return F.format_string(f"%+.{digits}f", col.cast("double"))


def log_tail(col: Column, limit: int = 10000) -> Column:
    """Last ``limit`` characters."""
    return F.right(col, F.lit(limit))


def safe_ratio(num: Column, den: Column, undefined: Column | None = None) -> Column:
    """num/den, or ``undefined`` (NULL by default) when den is 0."""
    out = F.when(den != 0, num.cast("double") / den.cast("double"))
    return out if undefined is None else out.otherwise(undefined)
