"""Arrow batches of texts as numpy arrays: words, hashes and per-document sums.

Texts travel as binary columns, so a batch is one byte buffer with offsets and
the word work is array arithmetic over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c

SLICE_BYTES = 4 << 20
HASH_STEP = np.uint64(0x9E3779B97F4A7C15)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id and the text as bytes; a null text is empty. Other columns, whatever their names, stay behind."""
    text = F.coalesce(c(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(c(id_col).alias("id"), text.alias("text"), *more)


def with_kept(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """id_and_text plus ``keep_...`` columns. The text itself is kept by travelling once: ``gone`` marks null ones."""
    more = [c(k).alias(f"keep_{k}") for k in keep if k != text_col]
    if text_col in keep:
        more.append(c(text_col).isNull().alias("gone"))
    return id_and_text(docs, id_col, text_col, *more)


def kept_column(name: str, text_col: str = "text") -> Column:
    """A column kept by with_kept under its own name."""
    return (F.when(~F.col("gone"), F.col("text").cast("string")) if name == text_col else c(f"keep_{name}")).alias(name)


def carried(names: list[str]) -> list[str]:
    """Columns a scan passes on: the text only where it is to be kept."""
    return [n for n in names if n != "text" or "gone" in names]


def ddl(d: DataFrame) -> str:
    """Schema text of the columns a scan passes on."""
    names = set(carried(d.columns))
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name in names)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches to about ``size`` text bytes; a single longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch[col]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets with one entry more than texts)."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_table(keep: str, lower: bool = True) -> np.ndarray:
    """256 entries: the byte a word character becomes, 0 for separators.

    ``keep`` is "alnum" (digits, letters and all of non-ASCII), "letter" (ASCII
    letters and non-ASCII) or "solid" (all but tab to carriage return and space).
    """
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    ascii_ = np.arange(256) < 128
    letter = ((t >= 97) & (t <= 122)) | ((t >= 65) & (t <= 90))
    digit = (t >= 48) & (t <= 57)
    if keep == "solid":
        drop = (t == 32) | ((t >= 9) & (t <= 13))
    else:
        drop = ascii_ & ~(letter | (digit if keep == "alnum" else False))
    return np.where(drop, 0, t).astype(np.uint8)


@dataclass
class Words:
    """Words of a run of texts: byte spans in the buffer, 64-bit hashes, first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    norm: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.norm[self.starts[i] : self.ends[i]].tobytes()

    def text_of(self) -> np.ndarray:
        """Number of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a per-word array over each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]


def powers(n: int) -> np.ndarray:
    """Odd multipliers, one for each place in a word; the table is kept and doubled when a longer word comes."""
    have = powers.__dict__.setdefault("kept", np.ones(64, np.uint64))
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        have = np.multiply.accumulate(np.full(size, HASH_STEP, np.uint64))
        powers.__dict__["kept"] = have
    elif have[-1] == 1:
        have = powers.__dict__["kept"] = np.multiply.accumulate(np.full(len(have), HASH_STEP, np.uint64))
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    norm = table[data]
    solid = norm != 0
    n = len(norm)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    after = np.concatenate([solid[1:], [False]]) if n else solid
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if hashed and len(starts):
        lengths = ends - starts
        chars = norm[solid]
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(chars)) - np.repeat(begin, lengths)
        h = np.add.reduceat(chars * powers(int(lengths.max()))[place], begin)
        hashes = mixed(h + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    else:
        hashes = np.zeros(len(starts), np.uint64)
    return Words(starts, ends, hashes, first, norm)
