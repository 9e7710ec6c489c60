"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on labelled rows, every path from a root becomes a
conjunction of comparisons, a lasso logistic model picks and weighs the
conjunctions, and what is left is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.crf import held_out
from tabwright.llm.text import Words, buffer_of, byte_table, id_and_text, slices, words_of
from tabwright.session import write_through

STATISTICS = (
    "log_words", "word_bytes", "upper", "digit", "symbol", "shout", "distinct", "top_word", "same_as_before", "dup_lines", "line_words", "stops", "bars", "wide",
)


def share_of(table: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(table.encode(), np.uint8)] = True
    return out


UPPER, DIGIT = share_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share_of("0123456789")
SYMBOL, SHOUT, STOP, BAR = share_of("#*$%&<>^~=+@_\\{}"), share_of("!"), share_of(".?;:"), share_of("|")
LETTER = byte_table("letter") != 0


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n_texts = len(offsets) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    w = words_of(data, offsets, byte_table("solid"))
    n = np.diff(w.first).astype(float)
    words, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    length = w.per_text(w.ends - w.starts)
    before = np.zeros(len(w), bool)
    before[1:] = w.hashes[1:] == w.hashes[:-1]
    before[w.first[:-1][w.first[:-1] < len(w)]] = False
    distinct, top = distinct_words(w, n_texts)
    lines, dup = repeated_lines(data, offsets)
    solid = np.maximum(length, 1)
    cols = [
        np.log1p(n), length / words, count(UPPER) / np.maximum(count(LETTER), 1), count(DIGIT) / solid, count(SYMBOL) / solid, count(SHOUT) / words,
        distinct / words, top / words, w.per_text(before) / words, dup / np.maximum(lines, 1), n / np.maximum(lines, 1), count(STOP) / words,
        count(BAR) / words, count(np.arange(256) >= 128) / size,
    ]
    return np.stack(cols, 1)


def distinct_words(w: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, occurrences of the commonest) of each text."""
    text = w.text_of()
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(h)]]))
    top = np.zeros(n_texts)
    np.maximum.at(top, t[at], times)
    return np.bincount(t[at], minlength=n_texts).astype(float), top


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a character, those equal to an earlier one) of each text."""
    table = np.arange(256, dtype=np.uint8)
    table[10] = 0
    table[0] = 1
    return_lines = words_of(data, offsets, table)
    distinct, _ = distinct_words(return_lines, len(offsets) - 1)
    lines = np.diff(return_lines.first).astype(float)
    return lines, lines - distinct


def measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = statistics(*buffer_of(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(made[:, i]) for i in range(len(STATISTICS))]], ["id", *STATISTICS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, STATISTICS...) of every row; a null text is empty and an empty text has zeros."""
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(measuring, f"id {kind}, " + ", ".join(f"{x} double" for x in STATISTICS))


#: (statistic, True for "at most", bound)
Test = tuple[str, bool, float]


def paths(node, so_far: tuple[Test, ...], names: tuple[str, ...], out: set[tuple[Test, ...]]) -> None:
    """Every path from the root of a tree to a node, tests on one statistic drawn together."""
    if so_far:
        bounds: dict[tuple[str, bool], float] = {}
        for name, low, at in so_far:
            old = bounds.get((name, low))
            bounds[name, low] = at if old is None else min(old, at) if low else max(old, at)
        out.add(tuple(sorted((name, low, at) for (name, low), at in bounds.items())))
    if node.subtreeDepth() > 0:
        name, at = names[node.split().featureIndex()], node.split().threshold()
        paths(node.leftChild(), (*so_far, (name, True, at)), names, out)
        paths(node.rightChild(), (*so_far, (name, False, at)), names, out)


def test_column(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for name, low, at in rule:
        out = out & ((c(name) <= at) if low else (c(name) > at))
    return out.cast("double")


@dataclass
class RuleModel:
    base: float
    rules: list[tuple[tuple[Test, ...], float]]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + test_column(rule) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(labelled: DataFrame, names: tuple[str, ...] = STATISTICS, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleModel:
    """Rules and weights from rows of statistics with ``label`` 0 or 1.

    Without both labels the score is the smoothed share of label 1 (a half for no rows).
    """
    seen = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = seen.get(1.0, 0), seen.get(0.0, 0)
    prior = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if not ones or not zeros:
        return RuleModel(prior, [])
    rows = write_through(VectorAssembler(inputCols=list(names), outputCol="features").transform(labelled).select("label", "features", *names), "rule-rows")
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(rows)
    found: set[tuple[Test, ...]] = set()
    for tree in forest.trees:
        paths(tree._call_java("rootNode"), (), names, found)
    rules = sorted(found)
    if not rules:
        return RuleModel(prior, [])
    columns = [f"rule_{i}" for i in range(len(rules))]
    fired = rows.select("label", *[test_column(r).alias(x) for r, x in zip(rules, columns, strict=True)])
    wide = VectorAssembler(inputCols=columns, outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(wide)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(x)) for r, x in zip(rules, weights, strict=True) if x])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_rows: int = 20_000, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Fits on at most ``label_rows`` labelled ids that are not held out, the least by
    a hash of the id, whatever the size of the table; everything is scored. Labels
    other than 0 and 1 are left out, a repeated id has its largest label. A null
    or empty text is scored by its zero statistics; repeated rows get equal scores.
    """
    measured = write_through(text_statistics(docs, id_col, text_col), "text-statistics")
    known = labels.select(c(id_col).alias("id"), c(label_col).cast("double").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("id"), 4)).groupBy("id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(label_rows)
    model = fit_rules(measured.join(picked, "id").select("label", *STATISTICS))
    score = model.score()
    return measured.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4).alias("held_out"), score.alias("score"), (score >= cut).cast("int").alias("predicted"))
