"""Exact byte-pair encoding in linear time, and decoding by an offset table.

A word's encoding is the one sequence of tokens whose neighbours are all
compatible: merging the bytes of two neighbours by the rules gives the two back.
The encoder takes the longest token at each place (found for all places at once
by an Aho-Corasick automaton run from the back), shortens it while it clashes
with the token before, and steps back over places where nothing fits; a place
left that way is never entered again, which keeps the work linear.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.text import id_and_text, slices

#: Fixed value: the pattern that splits a text before the merges of a byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 450_000
KEPT_PAIRS = 500_000
LONGEST_KEPT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens, from the JSON of a byte-level vocabulary."""

    def __init__(self, text: str) -> None:
        j = json.loads(text)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[ch] for ch in s)
        self.ids = {to_bytes(s): i for s, i in j["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        self.rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        #: token -> the two parts that the merges make it of
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in self.rank:
            self.halves.setdefault(a + b, (a, b))
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        table: list[bytes] = [b""] * size
        for s, i in self.ids.items():
            table[i] = s
        for s, i in self.special.items():
            table[i] = s.encode()
        self.table = table
        #: decoding: token i is bytes[offsets[i]:offsets[i + 1]]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in table])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered at once through the offset table."""
        ids = ids.astype(np.int64)
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        place = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[place].tobytes()

    def decoded_text(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; stray bytes become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace").encode()


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.back = ahocorasick.Automaton()
        for s in vocabulary.ids:
            self.back.add_word(s[::-1].decode("latin-1"), s)
        self.back.make_automaton()
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.shorter: dict[bytes, bytes | None] = {}
        self.edges: tuple[dict[bytes, list], dict[bytes, list]] = ({}, {})
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None
        #: ids of pieces seen lately, in two generations: the older goes when the newer is full
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wide = len(vocabulary.table) > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")

    def merged(self, text: bytes) -> list[bytes]:
        """Merges by the rules, lowest rank first: the definition that fills the compatibility table."""
        parts = [text[i : i + 1] for i in range(len(text))]
        rank = self.v.rank
        while len(parts) > 1:
            r, i = min((rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            a, b = parts[i], parts[i + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def usable(self, token: bytes) -> bool:
        """The merges make this token of its own bytes."""
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(token) == [token]
        return ok

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The parts that touch one end of a token while it is made: (part, rank that makes it, rank that consumes it)."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, 1 << 60
            while True:
                halves = self.v.halves.get(part) if len(part) > 1 else None
                since = self.v.rank[halves] if halves else -1
                known.append((part, since, until))
                if not halves:
                    break
                part, until = halves[side], since
            self.edges[side][token] = known
        return known

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Merging the bytes of both leaves the two tokens; with an empty ``a``, that ``b`` makes itself.

        A rule joins across the border if its two parts touch there at the same
        time and it comes before the rules that consume them.
        """
        if not a:
            return self.usable(b)
        if not self.usable(b):
            return False
        rank = self.v.rank
        for x, x_from, x_to in self.edge(a, 1):
            for y, y_from, y_to in self.edge(b, 0):
                if x_from < y_to and y_from < x_to:
                    r = rank.get((x, y))
                    if r is not None and r < x_to and r <= y_to:
                        return False
        return True

    def prefix(self, token: bytes) -> bytes | None:
        """The next shorter token that starts ``token``."""
        if token not in self.shorter:
            ids = self.v.ids
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in ids), None)
        return self.shorter[token]

    def word(self, text: bytes) -> list[bytes]:
        if text in self.v.ids and self.usable(text):
            return [text]
        n, fits = len(text), self.fits
        longest: list[bytes | None] = [None] * (n + 1)
        for end, s in self.back.iter(text[::-1].decode("latin-1")):  # the longest comes first at each place
            if longest[n - 1 - end] is None:
                longest[n - 1 - end] = s
        closed = bytearray(n + 1)
        out: list[bytes] = []
        at, last, token = 0, b"", longest[0]
        while at < n:
            while token is not None:
                if not closed[at + len(token)]:
                    ok = fits.get((last, token))
                    if ok is None:
                        if len(fits) >= KEPT_PAIRS:
                            fits.clear()
                        ok = fits[last, token] = self.compatible(last, token)
                    if ok:
                        break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at += len(token)
                last, token = token, longest[at]
            else:
                closed[at] = 1
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else b""
                token = self.prefix(token)
        return out

    def _fresh(self, piece: str) -> bytes:
        ids = self.v.ids
        return np.array([ids[t] for w in self.split.findall(piece) for t in self.word(w.encode())], self.dtype).tobytes()

    def pieces(self, text: str) -> list[str]:
        """Cuts before single spaces between solid characters, where no token can cross."""
        return cut_at_spaces(text)

    def encode_plain(self, text: str) -> bytes:
        kept, out = self.kept, []
        for p in self.pieces(text):
            got = kept.get(p)
            if got is None:
                got = self.older.get(p)
                if got is None:
                    got = self._fresh(p)
                if len(p) <= LONGEST_KEPT:
                    if len(kept) >= KEPT_WORDS:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids; special tokens spelled out in the text become their ids, as the tokenizer file asks."""
        if self.specials is None or not any(s in text for s in self.v.special):
            return np.frombuffer(self.encode_plain(text), self.dtype)
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts += [np.frombuffer(self.encode_plain(text[at : m.start()]), self.dtype), np.array([self.v.special[m[0]]], self.dtype)]
            at = m.end()
        return np.concatenate([*parts, np.frombuffer(self.encode_plain(text[at:]), self.dtype)])


#: every character that a splitting pattern might call white space
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
WIDE_BLANKS = "\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
SAFE_SPACE = regex.compile(rf"(?<=[^ {BLANKS}{WIDE_BLANKS}]) (?=[^ {BLANKS}{WIDE_BLANKS}])")
BESIDE = tuple(x for b in BLANKS for x in (f" {b}", f"{b} ")) + ("  ",)


def split_at_spaces(text: str) -> list[str]:
    """The text cut at single spaces between solid characters, those spaces left out."""
    plain = text[:1] != " " and text[-1:] != " " and not any(b in text for b in BESIDE)
    if plain and not text.isascii():
        plain = not any(b in text for b in WIDE_BLANKS)
    return text.split(" ") if plain else SAFE_SPACE.split(text)


def cut_at_spaces(text: str) -> list[str]:
    """Pieces that add up to the text; each but the first starts with the space it was cut before."""
    if not text:
        return []
    parts = split_at_spaces(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


class Shipped:
    """A vocabulary file read on the driver and sent to the tasks, where each worker builds its tables once."""

    def __init__(self, spark, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.key = hashlib.sha256(text.encode()).hexdigest()
        self.text = spark.sparkContext.broadcast(text)

    def encoder(self) -> Encoder:
        made = _MADE.get(self.key)
        if made is None:
            _MADE.clear()
            made = _MADE[self.key] = Encoder(Vocabulary(self.text.value))
        return made


_MADE: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def mapped(docs: DataFrame, vocab: str | None, columns: str, rows, id_col: str, text_col: str) -> DataFrame:
    d = id_and_text(docs, id_col, text_col)
    shipped = Shipped(docs.sparkSession, vocab or default_path())
    kind = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shipped.encoder()
        for batch in slices(batches, 2 << 20):
            made = rows(e, (t.decode("utf-8", "replace") for t in batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["id"], *made.values()], ["id", *made])

    return d.mapInArrow(run, f"id {kind}, {columns}")


def encode_texts(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, round_trip) of every row: token ids, and whether decoding them gives the text back.

    A null text is empty; an empty text has no ids; repeated rows are encoded
    each; other columns stay behind. ``vocab`` is a byte-level vocabulary file
    readable by the driver.
    """

    def rows(e: Encoder, texts: Iterable[str]) -> dict[str, pa.Array]:
        ids, same = [], []
        for t in texts:
            ids.append(e.encode(t).astype(np.int32))
            same.append(e.v.decoded_text(ids[-1]) == t.encode())
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "round_trip": pa.array(same, pa.bool_())}

    return mapped(docs, vocab, "ids array<int>, round_trip boolean", rows, id_col, text_col)


def decode_ids(encoded: DataFrame, vocab: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give an empty text, ids outside the vocabulary an error."""
    shipped = Shipped(encoded.sparkSession, vocab or default_path())
    d = encoded.select(c(id_col).alias("id"), F.coalesce(c(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.encoder().v
        for batch in batches:
            texts = [v.decoded_text(np.array(x, np.int64)).decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], ["id", "text"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, made from the encoder's ids; see encode_texts."""

    def rows(e: Encoder, texts: Iterable[str]) -> dict[str, pa.Array]:
        numbers = e.__dict__.setdefault("numbers", [str(i) for i in range(len(e.v.table))])
        counts, ids_hash, text_hash = [], [], []
        for t in texts:
            ids = e.encode(t)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids.tolist())).encode()).hexdigest())
            text_hash.append(hashlib.sha256(e.v.decoded_text(ids)).hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}

    return mapped(docs, vocab, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", rows, id_col, text_col).withColumnRenamed("id", "doc_id")
