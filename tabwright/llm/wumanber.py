"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of consecutive benchmark words. A table of shifts, indexed
by a hash of the last three words at a position, tells how far no window can
end; only where it says zero are the windows with that last block looked up, and
their words compared directly. Texts are read in lanes of a few hundred
positions that skip side by side as numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.exprs import c
from tabwright.llm.text import Words, buffer_of, byte_table, mixed, slices, with_kept, words_of

TABLE_BITS = 20
LANE = 384
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def hash_block(parts: list[np.ndarray]) -> np.ndarray:
    h = parts[0].copy()
    for p in parts[1:]:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


@dataclass
class Search:
    """Tables for windows of one length."""

    windows: list[tuple[bytes, ...]]
    owners: list[list]
    length: int = field(init=False)
    block: int = field(init=False)

    def __post_init__(self) -> None:
        self.length = len(self.windows[0])
        self.block = min(3, self.length)
        joined = b" ".join(b" ".join(w) for w in self.windows)
        data = np.frombuffer(joined, np.uint8)
        h = words_of(data, np.array([0, len(data)]), byte_table("alnum")).hashes.reshape(len(self.windows), self.length)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.uint8 if self.length < 250 else np.int64)
        for end in range(self.block, self.length + 1):
            key = hash_block([h[:, j] for j in range(end - self.block, end)]) & mask
            np.minimum.at(self.shift, key.astype(np.int64), self.length - end)
        suffix = hash_block([h[:, j] for j in range(self.length - self.block, self.length)])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.hashes = suffix[order], h[order]
        self.windows = [self.windows[i] for i in order]
        self.owners = [self.owners[i] for i in order]

    def find(self, w: Words) -> Iterator[tuple[int, int]]:
        """(last word, window number) of every occurrence."""
        m, b = self.length, self.block
        lows, highs = w.first[:-1] + m - 1, w.first[1:]
        some = lows < highs
        lows, highs = lows[some], highs[some]
        if not len(lows):
            return
        count = -(-(highs - lows) // LANE)
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(lows, count) + number * LANE
        stop = np.minimum(at + LANE, np.repeat(highs, count))
        mask = np.uint64((1 << TABLE_BITS) - 1)
        ends, keys = [], []
        while len(at):
            key = hash_block([w.hashes[at - j] for j in range(b - 1, -1, -1)])
            step = self.shift[(key & mask).astype(np.int64)].astype(np.int64)
            here = step == 0
            ends.append(at[here])
            keys.append(key[here])
            at = at + np.maximum(step, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        low, high = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        some = high > low
        ends, low, many = ends[some], low[some], (high - low)[some]
        place = np.repeat(ends, many)
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        for j in range(m):
            same = w.hashes[place - (m - 1 - j)] == self.hashes[which, j]
            place, which = place[same], which[same]
        for p, k in zip(place.tolist(), which.tolist(), strict=True):
            if all(w.word(p - m + 1 + j) == x for j, x in enumerate(self.windows[k])):
                yield p, k


def windows_of(text: bytes, size: int) -> list[tuple[bytes, ...]]:
    words = WORD.findall(text.lower())
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def searches(items: list[tuple[object, bytes]], size: int) -> list[Search]:
    """One search for each window length that occurs."""
    owners: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        for w in windows_of(text, size):
            owners.setdefault(w, set()).add(item)
    by_length: dict[int, list] = {}
    for w, own in owners.items():
        by_length.setdefault(len(w), []).append((w, [x for x in own if x is not None]))
    return [Search([w for w, _ in x], [o for _, o in x]) for _, x in sorted(by_length.items())]


SPANS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def joined_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def benchmark_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    *keep: str,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """(id, n_words, spans, items) of every document row.

    ``spans`` are the joined [first word, end word) stretches inside benchmark
    windows, ``items`` the ids (as sorted strings) whose windows occur. An item of
    fewer words than a window is one window; one without words has none. Null
    texts have no words; an item without an id marks words but is not listed.
    Repeated rows each get their own answer; an empty benchmark marks nothing.

    The benchmark is read to the driver in blocks of about ``block_bytes`` of
    text, each sent to the tasks as one search, and each document passes all
    blocks in turn, so what is broadcast at once is bounded whatever the size.
    Only ``id_col``, ``text_col`` and the columns in ``keep`` are read.
    """
    spark = docs.sparkSession
    bench = benchmark.select(c(item_col).cast("string").alias("item"), c(item_text_col).cast("binary").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = with_kept(docs, id_col, text_col, keep).select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables = spark.sparkContext.broadcast(searches([(r["item"], bytes(r["text"])) for r in part.collect()], window))
        out = out.mapInArrow(marker(tables), out.schema)
    return out


def marker(tables):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table("alnum")
        for batch in slices(batches):
            w = words_of(*buffer_of(batch["text"]), table)
            spans, items = batch["spans"].to_pylist(), [set(x) for x in batch["items"].to_pylist()]
            for search in tables.value:
                for last, k in search.find(w):
                    d = int(np.searchsorted(w.first, last, "right")) - 1
                    end = last - int(w.first[d]) + 1
                    spans[d].append([end - search.length, end])
                    items[d].update(search.owners[k])
            schema = batch.schema
            new = {
                "n_words": pa.array(np.diff(w.first), pa.int64()),
                "spans": pa.array([joined_spans(s) for s in spans], schema.field("spans").type),
                "items": pa.array([sorted(s) for s in items], schema.field("items").type),
            }
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch[f.name]) for f in schema], schema=schema)

    return mark


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document row; see benchmark_spans."""
    found = benchmark_spans(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


