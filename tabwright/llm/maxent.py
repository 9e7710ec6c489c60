"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) P(word | class). The class is a softmax
whose features are the previous word, the previous pair and two skips, hashed
into rows of weights, on top of each class's share of the training tokens; inside
a class words go by their counts plus one, and one unknown word has a count of
zero. With no weights learned this is the unigram model with one added.

Texts are tokenised once into blocks, each with its own word list. Counts of the
whole corpus meet the blocks again by joining the words of each block, so no
task or driver ever holds the vocabulary.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabwright.functions.exprs import c
from tabwright.llm.crf import held_out
from tabwright.llm.text import id_and_text, mixed, slices
from tabwright.session import scratch_path, write_through

CLASSES = 16
ROWS = 1 << 13
#: distances of the earlier words that make up each feature
FEATURES = ((1,), (1, 2), (2,), (3,))
BLOCK_BYTES = 16 << 20
STEP_TOKENS = 1 << 13
CHUNKS = 16
#: the end of a text; no word can hold white space
END = b"\n"


def blocks_schema(id_type) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()), ("ids", pa.list_(to_arrow_type(id_type))), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
            ("tokens", pa.binary()), ("words", pa.binary()), ("n_train", pa.binary()),
        ]
    )


def blocking(schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, held, sizes, tokens = [], [], [], []
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        vocabulary[END]
        seq = size = 0

        def block() -> pa.RecordBatch:
            every = np.concatenate(tokens)
            learn = np.repeat(~np.array(held, bool), sizes)
            n = np.bincount(every[learn], minlength=len(vocabulary)).astype("<i8")
            row = [[part << 24 | seq], [ids], [held], [sizes], [every.astype("<u4").tobytes()], [b" ".join(vocabulary)], [n.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for one, out, text in zip(batch["id"].to_pylist(), batch["held"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = text.lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
                ids.append(one)
                held.append(out)
                sizes.append(len(words))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield block()
                    seq, size = seq + 1, 0
                    ids, held, sizes, tokens = [], [], [], []
                    vocabulary.clear()
                    vocabulary[END]
        if ids:
            yield block()

    return cut


def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, block, local, n): a row for each word of each block, with its training count there."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch["words"][i].as_py().split(b" ")
            n = np.frombuffer(batch["n_train"][i].as_py(), "<i8")
            block = batch["block"][i].as_py()
            for a in range(0, len(words), 1 << 16):
                part = words[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(np.full(len(part), block)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(n[a : a + len(part)])],
                    ["word", "block", "local", "n"],
                )


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def rows_of(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the weight table, a column per feature, for every token; before a text stands a fixed value."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = {}
    for k in {k for f in FEATURES for k in f}:
        b = np.zeros(len(h), np.uint64)
        b[k:] = h[:-k] if k < len(h) else 0
        b[place < k] = np.uint64(k)
        back[k] = b
    out = np.empty((len(h), len(FEATURES)), np.int64)
    for j, f in enumerate(FEATURES):
        x = np.zeros(len(h), np.uint64)
        for k in f:
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + back[k])
        out[:, j] = (x & np.uint64(ROWS - 1)).astype(np.int64) + j * ROWS
    return out


def class_logs(rows: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log-softmax over the classes for each row of features."""
    z = prior + weights[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        z += weights[rows[:, j]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def learning(shipped, prior: np.ndarray, salts: int, rate: float):
    """Adaptive steps over a task's training tokens from the shared weights; gives the change times the tokens."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shipped.value
        w, square = start.copy(), np.full(start.shape, 1e-4, np.float32)
        seen = 0
        for batch in batches:
            for i in range(batch.num_rows):
                h = word_hashes(batch["words"][i].as_py().split(b" "))
                tokens = np.frombuffer(batch["tokens"][i].as_py(), "<u4")
                sizes = np.array(batch["sizes"][i].as_py())
                learn_it = ~np.array(batch["held"][i].as_py(), bool)
                tokens, sizes = tokens[np.repeat(learn_it, sizes)], sizes[learn_it]
                # whole texts up to about a million tokens at a time
                group = np.cumsum(sizes) // (1 << 20)
                at = 0
                for g in np.unique(group):
                    own = sizes[group == g]
                    part = h[tokens[at : at + own.sum()]]
                    at += int(own.sum())
                    rows, target = rows_of(part, own), (part & np.uint64(CLASSES - 1)).astype(np.int64)
                    for a in range(0, len(part), STEP_TOKENS):
                        r, y = rows[a : a + STEP_TOKENS], target[a : a + STEP_TOKENS]
                        miss = np.exp(class_logs(r, w, prior))
                        miss[np.arange(len(y)), y] -= 1
                        flat = miss.ravel()
                        for j in range(r.shape[1]):
                            low = j * ROWS
                            cell = ((r[:, j] - low)[:, None] * CLASSES + np.arange(CLASSES)).ravel()
                            g_ = (np.bincount(cell, flat, ROWS * CLASSES).reshape(ROWS, CLASSES) / len(y)).astype(np.float32)
                            square[low : low + ROWS] += g_ * g_
                            w[low : low + ROWS] -= rate * g_ / np.sqrt(square[low : low + ROWS])
                    seen += len(part)
        if seen:
            change = ((w - start) * seen).astype(np.float32)
            size = len(change) // CHUNKS
            salt = TaskContext.get().partitionId() % salts
            for k in range(CHUNKS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([seen], pa.int64()), pa.array([change[k * size : (k + 1) * size].tobytes()], pa.binary())],
                    ["chunk", "salt", "seen", "change"],
                )

    return learn


CHANGES = "chunk int, salt int, seen bigint, change binary"


def summing(table: pa.Table) -> pa.Table:
    total = np.zeros(0, np.float32)
    for x in table["change"]:
        part = np.frombuffer(x.as_buffer(), np.float32)
        total = total + part if len(total) else part.copy()
    return pa.table({"chunk": table["chunk"][:1], "salt": table["salt"][:1], "seen": pa.array([sum(table["seen"].to_pylist())], pa.int64()), "change": pa.array([total.tobytes()], pa.binary())})


def scoring(shipped, mass: np.ndarray, n_all: int, n_words: int, out: pa.Schema):
    prior = log_shares(mass)
    log_mass = np.log(np.maximum(mass, 1e-300))
    base_all = math.log10(n_all + (n_words + 1))

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        made: dict[str, list] = {f.name: [] for f in out}
        for i in range(block.num_rows):
            words = block["words"][i].as_py().split(b" ")
            h, count = word_hashes(words), np.zeros(len(words), np.int64)
            if counts.num_rows:
                count[counts["local"].to_numpy()] = counts["c"].to_numpy()
            label = np.where(count > 0, (h & np.uint64(CLASSES - 1)).astype(np.int64), 0)
            inside = np.log(count + 1.0) - log_mass[label]
            base = np.log10(count + 1.0) - base_all
            tokens = np.frombuffer(block["tokens"][i].as_py(), "<u4").astype(np.int64)
            sizes = np.array(block["sizes"][i].as_py(), np.int64)
            full = np.empty(len(tokens))
            ends = np.cumsum(sizes)
            a = d = 0
            while d < len(sizes):
                # whole texts, about a quarter of a million tokens at a time
                to = max(d + 1, int(np.searchsorted(ends, a + (1 << 18), "right")))
                b = int(ends[to - 1])
                part = tokens[a:b]
                rows = rows_of(h[part], sizes[d:to])
                for x in range(0, b - a, 1 << 15):
                    logs = class_logs(rows[x : x + (1 << 15)], shipped.value, prior)
                    y = label[part[x : x + (1 << 15)]]
                    full[a + x : a + x + len(y)] = logs[np.arange(len(y)), y] + inside[part[x : x + (1 << 15)]]
                a, d = b, to
            begin = ends - sizes
            known = np.concatenate([[0], np.cumsum(count[tokens] > 0)])
            made["doc_id"] += block["ids"][i].as_py()
            made["held_out"] += block["held"][i].as_py()
            made["n_tokens"] += sizes.tolist()
            made["n_known"] += (known[ends] - known[begin]).tolist()
            made["train_tokens"] += [n_all] * len(sizes)
            made["base_score"] += np.add.reduceat(base[tokens], begin).tolist()
            made["score"] += (np.add.reduceat(full, begin) / math.log(10)).tolist()
        return pa.table({f.name: pa.array(made[f.name], f.type) for f in out})

    return score


def log_shares(mass: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(mass / mass.sum()), -700.0).astype(np.float32)


def lm_scores(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, rate: float = 0.1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``learn_from`` says which rows the model learns from; the others are held
    out. All of them are counted, and each is used for one gradient pass, spread
    over ``rounds``: in a round every task steps through its own blocks from the
    shared weights, and the changes, weighted by tokens, are averaged through two
    levels of sums. A null or empty text is one end token; repeated rows are
    counted and scored each; without training rows every token is unknown.
    """
    spark = docs.sparkSession
    held = ~F.coalesce(learn_from, F.lit(False))
    d = id_and_text(docs, id_col, text_col, held.alias("held"))
    id_type = d.schema["id"].dataType
    kind = id_type.simpleString()
    path = scratch_path(spark, "lm-blocks")
    columns = f"block bigint, ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, words binary, n_train binary"
    d.mapInArrow(blocking(blocks_schema(id_type)), columns).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)

    listed = blocks.select("block", "words", "n_train").mapInArrow(listing, "word binary, block bigint, local int, n bigint")
    totals = write_through(listed.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "lm-counts")
    shares = totals.groupBy(F.pmod(F.xxhash64("word"), F.lit(CLASSES)).cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    n_all, n_words = sum(r["c"] for r in shares), sum(r["v"] for r in shares)
    mass = np.zeros(CLASSES)
    for r in shares:
        mass[r["k"]] = r["c"] + r["v"]
    mass[0] += 1  # the unknown word

    weights = np.zeros((len(FEATURES) * ROWS, CLASSES), np.float32)
    salts = max(1, math.isqrt(blocks.count()))
    for r in range(rounds if n_all else 0):
        part = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r).select("held", "sizes", "tokens", "words")
        change = part.mapInArrow(learning(spark.sparkContext.broadcast(weights), log_shares(mass), salts, rate), CHANGES)
        change = change.groupBy("chunk", "salt").applyInArrow(summing, CHANGES).groupBy("chunk").applyInArrow(summing, CHANGES)
        size = len(weights) // CHUNKS
        for x in change.collect():  # a row for each of the CHUNKS pieces of the weights
            k = x["chunk"] * size
            weights = weights.copy()
            weights[k : k + size] += np.frombuffer(x["change"], np.float32).reshape(size, CLASSES) / max(1, x["seen"])

    counts = listed.select("word", "block", "local").join(totals, "word").select("block", "local", "c")
    out = pa.schema(
        [("doc_id", to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    score = scoring(spark.sparkContext.broadcast(weights), mass, n_all, n_words, out)
    return (
        blocks.select("block", "ids", "held", "sizes", "tokens", "words").groupBy("block").cogroup(counts.groupBy("block"))
        .applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )


def lm_report(docs: DataFrame, **options) -> DataFrame:
    """lm_scores that learns from the rows whose id's crc32 leaves a remainder other than 2 by 7."""
    return lm_scores(docs, ~held_out(c("doc_id"), 7), **options)
