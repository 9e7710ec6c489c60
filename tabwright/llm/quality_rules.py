"""Quality rules on columns only: counts, repetition and a hashed n-gram log-likelihood ratio.

Everything is a built-in column function, so texts never leave the JVM. Word and
word-pair hashes fall into a fixed number of buckets; two multinomials over the
buckets, one from trusted documents and one from all, give each bucket a log
ratio, and a document's verdict is its ratio per n-gram against a fixed
threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c

BLANK = "[\\x20\\x09-\\x0D]+"
BUCKETS = 4096
#: least mean log ratio, in nats per n-gram, of a document that is kept
THRESHOLD = -0.1
#: n-grams of neutral evidence added to every document, so a few words decide nothing
PRIOR_GRAMS = 20.0


def texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Row id, text and words; a null text is empty. The row's other columns stay behind."""
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    d = docs.select(c(id_col).alias("id"), text.alias("text"), *more)
    return d.withColumn("words", F.array_remove(F.split("text", BLANK), ""))


def hashed(d: DataFrame) -> DataFrame:
    """Adds ``h``, the word hashes."""
    return d.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once.

    A filter that the optimizer moves below these columns would otherwise repeat
    it for every element of a loop.
    """
    return F.transform(F.array(value), use)[0]


def grams() -> Column:
    """Buckets of the words and word pairs of column ``h``: words in the lower half, pairs in the upper."""

    def use(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)).cast("int") + BUCKETS)
        single = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
        return F.concat(single, F.slice(pairs, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))

    return bound(F.col("h"), use)


def repeats(d: DataFrame, width: int = 5) -> DataFrame:
    """Adds ``n_repeat_words``: words inside ``width``-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Only texts with a repeated window have
    their windows sorted.
    """
    none = F.array().cast("array<bigint>")

    def windows(h: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), window)).otherwise(none)

    def in_order(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))

    def repeated(s: Column) -> Column:
        same = lambda e, i, k: F.coalesce(F.get(s, i + k)["x"] == e["x"], F.lit(False))
        return F.filter(s, lambda e, i: same(e, i, -1) | same(e, i, 1))

    d = d.withColumn("s", bound(bound(F.col("h"), windows), in_order))
    twice = bound(F.col("s"), repeated)
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        places, start, lambda a, p: F.struct((a["n"] + p + width - F.greatest(p, a["end"])).cast("long").alias("n"), (p + width).alias("end")), lambda a: a["n"]
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, smooth: float = 1.0) -> list[float]:
    """Log of trusted over raw share for each of the ``2 * BUCKETS`` buckets; counts cover every document.

    ``trusted`` has the ids (column ``id``) of trusted documents. With none of
    them, or no words, every ratio is zero. The driver reads one row a bucket.
    """
    marks = trusted.where("id is not null").select(F.col("id").alias("mark")).distinct().hint("shuffle_hash")
    raw = docs.select(c(id_col).alias(id_col), c(text_col).alias(text_col))
    marked = raw.join(marks, raw[id_col] == marks["mark"], "left")
    d = hashed(texts(marked, id_col, text_col, F.col("mark").isNotNull().cast("int").alias("trust"))).select("trust", grams().alias("grams"))
    # an outer explode: for a plain one the optimizer adds a filter that repeats the word hashes at every pair
    counts = d.select("trust", F.explode_outer("grams").alias("b")).groupBy("b").agg(F.sum("trust").alias("t"), F.count(F.lit(1)).alias("r"))
    trust, rest = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for row in counts.where("b is not null").collect():
        trust[row["b"]], rest[row["b"]] = row["t"], row["r"]
    out: list[float] = []
    for a in (0, BUCKETS):
        t, r = trust[a : a + BUCKETS], rest[a : a + BUCKETS]
        t_all, r_all = sum(t) + smooth * BUCKETS, sum(r) + smooth * BUCKETS
        out += [math.log((x + smooth) / t_all) - math.log((y + smooth) / r_all) if sum(t) else 0.0 for x, y in zip(t, r, strict=True)]
    return out


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) of every row.

    ``trusted`` is a DataFrame with a column ``id``: the documents of the trusted
    multinomial. ``llr`` is the summed log ratio over the number of n-grams plus
    ``PRIOR_GRAMS``; a document is kept if no base rule failed and ``llr`` is at
    least ``threshold``. A null or empty text has no words and fails; repeated
    rows are judged each; other columns stay behind.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    d = repeats(hashed(texts(docs, id_col, text_col)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "id", "n_repeat_words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"), grams().alias("grams"),
    )
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (total / (F.size("grams") + PRIOR_GRAMS)).alias("llr"),
    )
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
