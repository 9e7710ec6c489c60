"""Exact ranks, running totals and previous-row lookups without one big window.

A window partitioned by a class, model or job puts that whole group into one
task. Here every group is first cut into order-preserving buckets; ranks and
sums are taken inside a bucket, and a small (group, bucket) table supplies the
offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.exprs import c, order_key
from tabwright.session import input_bytes


def known_bytes(df: DataFrame) -> int:
    """Input size for bucket counts; tables of unknown size (in-memory ones) are measured by their rows."""
    size = input_bytes(df)
    return size if size < 1 << 52 else 64 * df.count()


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps one copy of each key."""
    if not keys:
        raise ValueError("join needs at least one key")
    renamed = right
    cond = None
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
        test = c(k).eqNullSafe(c(f"__r_{k}"))
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def hash_digits(df: DataFrame) -> int:
    """Hex digits for hash buckets: a bucket covers about 32 MB of input or less."""
    wanted = max(16, known_bytes(df) // (32 << 20))
    return math.ceil(math.log(wanted, 16))


def ranked_by_hash(
    df: DataFrame,
    seed: int,
    key: Sequence[str],
    by: Sequence[str] = (),
    out: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """1-based position in each ``by`` group in seeded pseudo-random order.

    ``key`` must identify a row within its group. Buckets are prefixes of a
    uniform hash, so even a group holding a third of the table spreads evenly.
    """
    digits = digits or hash_digits(df)
    h = df.withColumn("__hash_key", order_key(seed, *[c(k) for k in key]))
    h = h.withColumn("__hash_bucket", F.substring("__hash_key", 1, digits))
    return _ranked(h, [*by], "__hash_bucket", [F.col("__hash_key"), *[c(k) for k in key]], out).drop("__hash_key", "__hash_bucket")


def _ranked(
    df: DataFrame, by: list[str], bucket: str, order: list[Column], out: str
) -> DataFrame:
    sizes = df.groupBy(*[c(k) for k in by], bucket).agg(F.count(F.lit(1)).alias("__bucket_rows"))
    before = Window.partitionBy(*[c(k) for k in by]).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *[c(k) for k in by],
        bucket,
        F.coalesce(F.sum("__bucket_rows").over(before), F.lit(0)).alias("__rows_before"),
    )
    inside = Window.partitionBy(*[c(k) for k in by], bucket).orderBy(*order)
    local = df.withColumn("__in_bucket", F.row_number().over(inside))
    return join_keys(local, offsets, [*by, bucket], "left").withColumn(
        out, (F.col("__rows_before") + F.col("__in_bucket")).cast("long")
    ).drop("__rows_before", "__in_bucket")


def value_buckets(df: DataFrame, col: str, out: str, buckets: int | None = None) -> DataFrame:
    """Adds an order-preserving bucket number balanced over the rows.

    One pass over the column finds approximate percentiles, one for each 32 MB of
    input unless ``buckets`` says otherwise, at least 16.
    """
    buckets = buckets or max(16, known_bytes(df) // (32 << 20))
    marks = df.agg(
        F.percentile_approx(c(col), [i / buckets for i in range(1, buckets)], max(10_000, 10 * buckets)).alias("m")
    ).first()["m"]
    edges = sorted({float(m) for m in (marks or []) if m is not None and math.isfinite(m)})
    splits = [-math.inf, *edges, math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def running_before(
    df: DataFrame,
    sums: dict[str, str],
    order_col: str,
    by: Sequence[str],
    descending: bool = True,
) -> DataFrame:
    """For each ``column -> name``: sum of the column over the rows strictly before each row.

    ``order_col`` must be distinct within a ``by`` group (group first).
    """
    b = value_buckets(df, order_col, "__vb")
    way = (lambda x: F.col(x).desc()) if descending else (lambda x: F.col(x).asc())
    keys = [c(k) for k in by]
    prev = (Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(way("__vb")).rowsBetween(*prev)
    inside = Window.partitionBy(*keys, "__vb").orderBy(way(order_col)).rowsBetween(*prev)
    zero = F.lit(0)
    totals = b.groupBy(*keys, "__vb").agg(*[F.sum(c(x)).alias(f"__t_{n}") for x, n in sums.items()])
    offsets = totals.select(
        *keys,
        "__vb",
        *[F.coalesce(F.sum(f"__t_{n}").over(across), zero).alias(f"__off_{n}") for n in sums.values()],
    )
    local = b.withColumns(
        {f"__in_{n}": F.coalesce(F.sum(c(x)).over(inside), zero) for x, n in sums.items()}
    )
    joined = join_keys(local, offsets, [*by, "__vb"], "left")
    out = joined.withColumns({n: c(f"__in_{n}") + c(f"__off_{n}") for n in sums.values()})
    return out.drop("__vb", *[f"__{p}_{n}" for p in ("in", "off") for n in sums.values()])


def whole_seconds(df: DataFrame, ts: str) -> Column:
    """Seconds since 1970 that rise with ``ts``; zoneless time is not read through a time zone."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_seconds(c(ts).cast("timestamp"))
    gap = c(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), gap)
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + F.floor(part("SECOND"))


def previous_in_time(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    tie: str,
    state: Column,
    out: str,
    bucket_seconds: int = 60,
) -> DataFrame:
    """``lag(state)`` per ``by`` group in (ts, tie) order, cut into time buckets.

    The first row of a bucket takes the last state of the latest earlier bucket
    of its group, read from a (group, bucket) table.
    """
    keys = [c(k) for k in by]
    d = df.withColumn("__st", state).withColumn(
        "__tb", F.floor(whole_seconds(df, ts) / F.lit(bucket_seconds))
    )
    last = d.groupBy(*keys, "__tb").agg(
        F.max_by("__st", F.struct(c(ts), c(tie))).alias("__last")
    )
    carry = last.select(
        *keys,
        "__tb",
        F.lag("__last").over(Window.partitionBy(*keys).orderBy("__tb")).alias("__carry"),
    )
    inside = Window.partitionBy(*keys, "__tb").orderBy(c(ts), c(tie))
    local = d.withColumn("__prev", F.lag("__st").over(inside))
    return (
        join_keys(local, carry, [*by, "__tb"], "left")
        .withColumn(out, F.coalesce("__prev", "__carry"))
        .drop("__st", "__tb", "__prev", "__carry")
    )


def numbered_copies(df: DataFrame, count_col: str, out: str, block: int = 100_000) -> DataFrame:
    """``count_col`` copies of each row numbered 1.. in ``out``.

    Numbers are made block by block, the blocks spread over tasks, so one row
    asking for billions of copies neither builds one array nor fills one task.
    """
    n = c(count_col)
    wide = df.where(n > 0).withColumn(
        "__blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block).cast("long")))
    )
    # a fixed partition count, since tiny block rows would otherwise be merged into one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = wide.repartition(parts, "__blk", *[c(x) for x in df.columns])
    first = F.col("__blk") * block + 1
    return wide.withColumn(
        out, F.explode(F.sequence(first, F.least(first + block - 1, n.cast("long"))))
    ).drop("__blk")
