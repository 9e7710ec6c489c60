"""Fill-in-middle over texts stored as seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` code points
with cumulative unit counts. A cut finds its frame by the counts, and only the
frames that hold a cut are decompressed to select code points; all others pass
whole, one at a time and in the order of the output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.text import buffer_of, id_and_text, slices
from tabwright.session import write_through

FRAME_UNITS = 1 << 14
LEVEL = 3
#: Marks of prefix, suffix and middle, shares (of 100) left plain and put suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHANGED, SUFFIX_FIRST = 90, 20
FRAMES = pa.list_(pa.binary())
COUNTS = pa.list_(pa.int64())


def unit_starts(text: np.ndarray) -> np.ndarray:
    """Byte offsets of the code points of UTF-8 bytes."""
    return np.flatnonzero((text & 0xC0) != 0x80)


def framing(units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for batch in slices(batches):
            data, ends = buffer_of(batch["text"])
            frames, counts, marked = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                text = data[a:b]
                starts = unit_starts(text)
                edges = [*starts[::units].tolist(), len(text)]
                frames.append([z.compress(text[x:y].tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)])
                counts.append([min(k, len(starts)) for k in range(0, len(starts) + units, units)] if len(starts) else [0])
                whole = text.tobytes()
                marked.append(any(m in whole for m in (PREFIX, SUFFIX, MIDDLE)))
            kept = [n for n in batch.schema.names if n != "text"]
            made = [pa.array(frames, FRAMES), pa.array(counts, COUNTS), pa.array(marked, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in kept], *made], [*kept, "frames", "counts", "marked"])

    return run


def store_frames(docs: DataFrame, *more: Column, id_col: str = "doc_id", text_col: str = "text", units: int = FRAME_UNITS) -> DataFrame:
    """(id, ..., frames, counts, marked) of every row: the text in frames, units before each frame and in all, and whether it holds a mark.

    A null text is empty and has no frame. Texts are stored whole, whatever their
    length; repeated rows stay.
    """
    d = id_and_text(docs, id_col, text_col, *more)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    return d.mapInArrow(framing(units), f"{kept}, frames array<binary>, counts array<bigint>, marked boolean")


class Frames:
    """Code points of one stored text, by decompressing as few frames as are asked for."""

    def __init__(self, frames: list[bytes], counts: np.ndarray):
        self.frames, self.counts = frames, counts
        self.units = int(counts[-1])
        self.z = zstandard.ZstdDecompressor()
        self.opened = 0

    def frame(self, k: int) -> bytes:
        self.opened += 1
        return self.z.decompress(self.frames[k])

    def split(self, k: int, at: int) -> int:
        """Byte offset in frame ``k`` of the code point with number ``at`` of the text."""
        starts = unit_starts(np.frombuffer(self.frame(k), np.uint8))
        at -= int(self.counts[k])
        return int(starts[at]) if at < len(starts) else -1

    def seek(self, at: int) -> tuple[int, int]:
        """(frame, byte offset within it) of a unit; (number of frames, 0) for the end of the text."""
        if at >= self.units:
            return len(self.frames), 0
        k = int(np.searchsorted(self.counts, at, "right")) - 1
        return k, 0 if at == self.counts[k] else self.split(k, at)

    def stream(self, start: tuple[int, int], end: tuple[int, int]) -> Iterator[bytes]:
        """Bytes between two places that ``seek`` gave, frame by frame."""
        for k in range(start[0], min(end[0] + (end[1] > 0), len(self.frames))):
            plain = self.frame(k)
            yield plain[start[1] if k == start[0] else 0 : end[1] if k == end[0] else len(plain)]


def draws(doc_id: str) -> list[int]:
    """Four 32-bit numbers of an id."""
    h = hashlib.sha256(b"1:" + doc_id.encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plan(doc_id: str, units: int, marked: bool) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) in units."""
    h = draws(doc_id)
    a, b = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    if units == 0 or marked or h[2] % 100 >= CHANGED:
        return "plain", a, b
    return ("spm" if h[3] % 100 < SUFFIX_FIRST else "psm"), a, b


def arranged(f: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output of a form, in pieces."""
    ends = (0, 0), (len(f.frames), 0)
    if form == "plain":
        yield from f.stream(*ends)
        return
    cut, back = f.seek(a), f.seek(b)
    prefix, middle, suffix = (ends[0], cut), (cut, back), (back, ends[1])
    parts = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
    for mark, part in [*parts, (MIDDLE, middle)]:
        yield mark
        yield from f.stream(*part)


def restored(output: bytes, form: str) -> list[bytes]:
    """The text as pieces in order, found by the marks of an output alone."""
    if form == "plain":
        return [output]
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, rest = output[len(first) :].split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return [tail, middle, head] if form == "spm" else [head, middle, tail]


RESULT = {
    "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string(),
}


def transforming(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for i in range(batch.num_rows):
                    f = Frames(batch["frames"][i].as_py(), batch["counts"][i].values.to_numpy(zero_copy_only=False))
                    form, a, b = plan(batch["name"][i].as_py(), f.units, batch["marked"][i].as_py())
                    sha, pieces = hashlib.sha256(), []
                    for piece in arranged(f, form, a, b):
                        sha.update(piece)
                        pieces.append(piece)
                    output = b"".join(pieces)
                    back = hashlib.sha256()
                    for piece in restored(output, form):
                        back.update(piece)
                    cuts = (None, None) if form == "plain" else (a, b - a)
                    rows.append((f.units, form, *cuts, sha.hexdigest(), back.hexdigest(), *([output.decode()] if texts else [])))
                kinds = [*RESULT.values(), *([pa.string()] if texts else [])]
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["id"], *made], ["id", *RESULT, *(["output"] if texts else [])])

    return run


def fill_in_middle(stored: DataFrame, texts: bool = True) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of every row of ``store_frames``.

    Cuts, form and order follow from the id alone, so a recomputed task gives
    the same rows and rows with equal ids and texts are equal. A null id draws as
    empty text. Texts that are empty or hold a mark stay plain. ``restored_sha256`` is of the text rebuilt
    from the output by its marks.
    """
    d = stored.select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), "frames", "counts", "marked")
    kind = stored.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in RESULT.items())
    return d.mapInArrow(transforming(texts), f"id {kind}, {columns}" + (", output string" if texts else ""))


def fim_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document, from frames written to the shared folder."""
    stored = write_through(store_frames(docs), "fim-frames")
    return fill_in_middle(stored, texts=False).withColumnRenamed("id", "doc_id")
