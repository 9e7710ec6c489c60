"""Token ids as files of frequency-ranked, byte-aligned variable-length codes.

A file is Parquet whose rows are blocks of whole documents in ascending id order.
Each block ranks its ids by how often they occur, writes a rank in as few bytes
as it needs, and keeps the byte counts apart: two bits a value, four values to a
control byte. Reading looks each control byte up in a table of four lengths, so
a block is decoded by array arithmetic.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.bpe import LONGEST_KEPT, default_path, split_at_spaces
from tabwright.llm.text import id_and_text, slices
from tabwright.session import scratch_path

KEPT_PIECES = 800_000
#: marks that end a word and start a token of their own
MARKS = '.,;:!?|"'
END_ID = 2
#: control byte -> the byte counts of its four values
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[start]
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[start[longer] + k] << np.uint32(8 * k)
    return out


def pack_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ids in rank order, control, data); the commonest id has rank 0, equal counts go by id."""
    count = np.bincount(ids)
    known = np.flatnonzero(count)
    ranked = known[np.argsort(-count[known], kind="stable")]
    rank = np.zeros(len(count), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    return ranked.astype("<u4").tobytes(), *pack(rank[ids])


def unpack_block(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ranked, "<u4")[unpack(control, data, n)] if n else np.zeros(0, "<u4")


class LibraryEncoder:
    """The tokenizers library, asked once for each word that a worker has not seen lately.

    A text falls into pieces at single spaces; a piece falls into words at single
    line breaks, and a word of letters sheds the marks behind it. The vocabulary's
    splitting pattern cuts at all those places too, so the ids simply add up.
    """

    def __init__(self, text: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: ids of a piece after a space, and of a piece without one
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def learn(self, spaced: set[str], bare: set[str]) -> None:
        """Adds the ids of pieces after a space and of pieces without one to the kept ones.

        Pieces that fall into smaller ones wait until those are known.
        """
        known_s, known_b = self.spaced, self.bare
        ask_s, ask_b = set(), set()
        waiting: list[tuple[str, bool, str, list[str]]] = []
        for group, after_space, ask in ((spaced, True, ask_s), (bare, False, ask_b)):
            for piece in group:
                if "\n" in piece:
                    first, *rest = piece.split("\n")
                    solid = first and not first[-1].isspace() and all(x and not x[0].isspace() and not x[-1].isspace() for x in rest)
                    if not solid or first[0].isspace():
                        ask.add(piece)
                        continue
                    tail = [x for line in rest for x in ("\n", *self.marked(line))]
                else:
                    first, tail = piece, []
                head, *marks = self.marked(first)
                if not marks and not tail:
                    ask.add(piece)
                    continue
                ask.add(head)
                ask_b.update(marks)
                ask_b.update(tail)
                waiting.append((piece, after_space, head, marks + tail))
        some_s = [p for p in ask_s if p not in known_s]
        some_b = [p for p in ask_b if p not in known_b]
        made = iter(self.tokenizer.encode_batch([" " + p for p in some_s] + some_b, add_special_tokens=False))
        known_s.update((p, array("I", next(made).ids).tobytes()) for p in some_s)
        known_b.update((p, array("I", next(made).ids).tobytes()) for p in some_b)
        for piece, after_space, head, rest in waiting:
            kept = known_s if after_space else known_b
            kept[piece] = b"".join([kept[head], *map(known_b.__getitem__, rest)])

    @staticmethod
    def marked(piece: str) -> tuple[str, ...]:
        """A word of letters and the marks behind it, or the piece itself."""
        if piece[-1:] in MARKS:
            head = piece.rstrip(MARKS)
            if head.isalpha():
                return head, piece[len(head) :]
        return (piece,)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.spaced) + len(self.bare) > KEPT_PIECES:
            self.spaced.clear()
            self.bare.clear()
        spaced, bare, rows = set(), set(), []
        for t in texts:
            #: a text that spells a special token is one piece
            first, *rest = [t] if any(s in t for s in self.special) else split_at_spaces(t)
            got = list(map(self.spaced.get, rest))
            gaps = [(i, rest[i]) for i, g in enumerate(got) if g is None] if None in got else []
            spaced.update([p for _, p in gaps])
            bare.add(first)
            rows.append((first, got, gaps))
        fresh = [p for p in bare if p not in self.bare]
        if spaced or fresh:
            self.learn(spaced, set(fresh))
        out = []
        for first, got, gaps in rows:
            for i, p in gaps:
                got[i] = self.spaced[p]
            out.append(self.bare[first] + b"".join(got))
        for pieces, kept in ((spaced, self.spaced), (fresh, self.bare)):
            for piece in pieces:
                if len(piece) > LONGEST_KEPT:
                    kept.pop(piece, None)
        return out


_MADE: dict[str, LibraryEncoder] = {}


def writing(shipped, key: str, block_tokens: int, schema: pa.Schema) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _MADE.get(key)
        if encoder is None:
            _MADE.clear()
            encoder = _MADE[key] = LibraryEncoder(shipped.value)
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        ids: list = []
        made: list[bytes] = []
        before, size = 0, 0

        def block() -> pa.RecordBatch:
            counts = [len(m) // 4 for m in made]
            n = sum(counts)
            ranked, control, data = pack_block(np.frombuffer(b"".join(made), "<u4"))
            row = [[part], [before], [n], [ids], [counts], [ranked], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches, 1 << 20):
            texts = [t.decode("utf-8", "replace") for t in batch["text"].to_pylist()]
            for one, got in zip(batch["id"].to_pylist(), encoder.encode_all(texts), strict=True):
                ids.append(one)
                made.append(got + end)
                size += len(got) // 4 + 1
                if size >= block_tokens:
                    yield block()
                    before += size
                    ids, made, size = [], [], 0
        if made:
            yield block()

    return write


def write_token_files(
    docs: DataFrame, path: str, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    block_tokens: int = 1_000_000, partition_bytes: int = 16 << 20,
) -> None:
    """Encodes every text, ends it with id 2 and writes the blocks below ``path`` in ascending id order.

    Documents are dealt out by ranges of ids into partitions of about
    ``partition_bytes`` of text; null ids come first, repeated ids stand together
    in an order fixed by their texts. A null or empty text is the end id alone.
    """
    spark = docs.sparkSession
    d = id_and_text(docs, id_col, text_col)
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // partition_bytes))
    with open(vocab or default_path(), encoding="utf-8") as f:
        text = f.read()
    kind = d.schema["id"].dataType
    columns = f"part int, before bigint, n_tokens bigint, ids array<{kind.simpleString()}>, counts array<int>, ranked binary, control binary, data binary"
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [
            ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))),
            ("counts", pa.list_(pa.int32())), ("ranked", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
        ]
    )
    write = writing(spark.sparkContext.broadcast(text), hashlib.sha256(text.encode()).hexdigest(), block_tokens, schema)
    ordered = d.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(write, columns).write.parquet(path)


def decoding(columns: Callable[[np.ndarray], dict], schema: pa.Schema) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch[n][i].as_py() for n in batch.schema.names}
                ids = unpack_block(row["ranked"], row["control"], row["data"], row["n_tokens"])
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                docs = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                made = {"doc_id": row["ids"], "start": starts + (row["offset"] + row["before"]), "n_tokens": row["counts"], **columns(docs)}
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return read


def read_blocks(spark: SparkSession, path: str, columns: Callable, name: str, sql: str, kind: pa.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    blocks = spark.read.parquet(path)
    id_type = blocks.schema["ids"].dataType.elementType
    # one row a file part: the only rows that meet in one task
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])
    return blocks.join(offsets, "part").mapInArrow(
        decoding(columns, schema), f"doc_id {id_type.simpleString()}, start bigint, n_tokens bigint, {name} {sql}"
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every document in the files; ``start`` counts the ids of all before it."""
    return read_blocks(spark, path, lambda docs: {"tokens": [d.astype(np.int64) for d in docs]}, "tokens", "array<bigint>", pa.list_(pa.int64()))


def token_file_digests(docs: DataFrame, vocab: str | None = None, path: str | None = None, **options) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from files written to ``path`` (else the shared folder) and read back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_token_files(docs, path, vocab, **options)
    return read_blocks(spark, path, lambda docs: {"ids_crc32": [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]}, "ids_crc32", "bigint", pa.int64())
