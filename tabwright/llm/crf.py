"""Language of words and texts by a linear-chain conditional random field.

A word's emission scores come from hashed byte n-grams, prefixes, suffixes, the
word itself and its place in per-language lexicons; a learned matrix scores the
step from one word's language to the next, so code-switched text is labelled
word by word. Forward-backward runs over all lines of a batch side by side; a
text's language is the one with the largest mean posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.text import Words, buffer_of, byte_table, carried, ddl, mixed, slices, with_kept, words_of

BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
STEP = tuple(np.uint64(x) for x in (1, 0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
NEWLINE = re.compile(rb"\n")


def letters_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of ASCII letters and non-ASCII bytes; A-Z and the capitals of Latin-1 are lowered."""
    folded = data
    if (data >= 0xC3).any():
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded = np.where(capital, data + 0x20, data).astype(np.uint8)
    return words_of(folded, offsets, byte_table("letter"))


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(SIZE - 1)).astype(np.int64)


def features(norm: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the weight table, words they belong to in rising order, their weight) per kind of feature."""
    n, length = len(starts), ends - starts
    out = [(bucket(hashes, 1), np.arange(n), np.ones(n, np.float32))]
    begin = np.cumsum(length) - length
    word = np.repeat(np.arange(n), length)
    place = np.arange(len(word)) - begin[word]
    x = norm[starts[word] + place].astype(np.uint64) if n else np.zeros(0, np.uint64)
    for size in (1, 2, 3):
        gram = np.zeros(max(0, len(x) - size + 1), np.uint64)
        for k in range(size):
            gram += x[k : len(gram) + k] * STEP[k]
        ok = place[: len(gram)] + size <= length[word[: len(gram)]]
        if size > 1:
            at = np.flatnonzero(ok)
            w = word[at]
            out.append((bucket(gram[at], 10 + size), w, (2.0 / (length[w] - size + 1)).astype(np.float32)))
        long = np.flatnonzero(length >= size)
        one = np.ones(len(long), np.float32)
        out.append((bucket(gram[begin[long]], 20 + size), long, one))
        out.append((bucket(gram[begin[long] + length[long] - size], 30 + size), long, one))
    return out


@dataclass
class Chains:
    """Word runs read as one sequence each, longest first."""

    start: np.ndarray
    length: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(-self.length, kind="stable")
        self.start, self.length = self.start[order], self.length[order]
        longest = int(self.length[0]) if len(self.length) else 0
        #: chains that reach each step
        self.active = len(self.length) - np.searchsorted(self.length[::-1], np.arange(longest), "right")


def posteriors(emit: np.ndarray, chains: Chains, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each word and label, expected steps between labels, log of the normaliser)."""
    n, labels = emit.shape
    top = emit.max(1, keepdims=True) if n else emit
    e = np.exp(emit - top)
    step, begin = np.exp(move), np.exp(first)
    alpha, scale = np.empty((n, labels)), np.ones(n)
    for t, k in enumerate(chains.active):
        at = chains.start[:k] + t
        a = e[at] * (begin if t == 0 else alpha[at - 1] @ step)
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    beta, moved = np.ones((n, labels)), np.zeros((labels, labels))
    for t in range(len(chains.active) - 1, 0, -1):
        at = chains.start[: chains.active[t]] + t
        b = e[at] * beta[at] / scale[at][:, None]
        moved += alpha[at - 1].T @ b
        beta[at - 1] = b @ step.T
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-300)
    return gamma, moved * step, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    lexicon: np.ndarray
    lexicon_label: np.ndarray
    lexicon_weight: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Label number whose lexicon has the word, else the number of labels."""
        none = len(self.labels)
        if not len(self.lexicon):
            return np.full(len(hashes), none)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.lexicon_label[at], none)

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of every word, worked out once for equal words."""
        _, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        out = self.lexicon_weight[self.lexicon_rows(w.hashes[at])].astype(np.float64)
        for row, word, weight in features(w.norm, w.starts[at], w.ends[at], w.hashes[at]):
            if len(row):
                begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[begin]] += np.add.reduceat(self.table[row] * weight[:, None], begin, axis=0)
        return out[back]

    def line_chains(self, w: Words, breaks: np.ndarray) -> Chains:
        """Chains end with the line and with the text."""
        line = np.searchsorted(breaks, w.starts)
        new = np.zeros(len(w), bool)
        new[w.first[:-1][w.first[:-1] < len(w)]] = True
        new[1:] |= line[1:] != line[:-1]
        start = np.flatnonzero(new)
        return Chains(start, np.diff(np.concatenate([start, [len(w)]])))

    def label_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        w = letters_of(data, offsets)
        if not len(w):
            return w, np.zeros((0, len(self.labels)))
        chains = self.line_chains(w, np.flatnonzero(data == 10))
        return w, posteriors(self.emissions(w), chains, self.move, self.first)[0]


def train(texts: list[bytes], langs: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adaptive gradient ascent on the conditional likelihood.

    Training sequences are made of short stretches of different texts in turn,
    so the steps between languages are learned from text that switches.
    """
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    L = len(labels)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    w = letters_of(joined, offsets)
    y_text = np.array([number[x] for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    # cut into stretches of 3 to 30 words, shuffle them, chain four in a row
    cuts = []
    for d in range(len(texts)):
        at, end = int(w.first[d]), int(w.first[d + 1])
        while at < end:
            to = min(end, at + int(rng.integers(3, 31)))
            cuts.append((at, to, y_text[d]))
            at = to
    order = rng.permutation(len(cuts))
    word = np.concatenate([np.arange(cuts[i][0], cuts[i][1]) for i in order]) if cuts else np.zeros(0, np.int64)
    y = np.concatenate([np.full(cuts[i][1] - cuts[i][0], cuts[i][2]) for i in order]) if cuts else np.zeros(0, np.int64)
    size = np.array([cuts[i][1] - cuts[i][0] for i in order], np.int64)
    size = np.add.reduceat(size, np.arange(0, len(size), 4)) if len(size) else size
    # lexicons: words seen at least 3 times, at least 9 in 10 with one label
    known, inverse = np.unique(w.hashes, return_inverse=True)
    counts = np.zeros((len(known), L))
    np.add.at(counts, (inverse, np.repeat(y_text, np.diff(w.first))), 1)
    sure = (counts.sum(1) >= 3) & (counts.max(1, initial=0) >= 0.9 * counts.sum(1)) if len(known) else np.zeros(0, bool)
    model = Model(labels, np.zeros((SIZE, L)), known[sure], counts[sure].argmax(1) if sure.any() else np.zeros(0, np.int64), np.zeros((L + 1, L)), np.zeros((L, L)), np.zeros(L))
    if L < 2 or not len(word):
        return model
    begin = np.cumsum(size) - size
    batches = np.array_split(np.arange(len(size)), max(1, len(word) // 20_000))
    squares = [np.full(x.shape, 1e-3) for x in (model.table, model.lexicon_weight, model.move, model.first)]
    for _ in range(epochs):
        for some in batches:
            if not len(some):
                continue
            a, b = int(begin[some[0]]), int(begin[some[-1]] + size[some[-1]])
            part, target = word[a:b], y[a:b]
            parts = features(w.norm, w.starts[part], w.ends[part], w.hashes[part])
            lex = model.lexicon_rows(w.hashes[part])
            emit = model.lexicon_weight[lex].copy()
            for row, at, weight in parts:
                for j in range(L):
                    emit[:, j] += np.bincount(at, model.table[row, j] * weight, len(part))
            chains = Chains(begin[some] - a, size[some])
            gamma, moved, _ = posteriors(emit, chains, model.move, model.first)
            miss = -gamma
            miss[np.arange(len(part)), target] += 1
            inside = np.ones(len(part), bool)
            inside[chains.start] = False
            step = -moved
            here = np.flatnonzero(inside)
            np.add.at(step, (target[here - 1], target[here]), 1)
            grad_table, grad_lex = np.zeros((SIZE, L)), np.zeros((L + 1, L))
            for j in range(L):
                for row, at, weight in parts:
                    grad_table[:, j] += np.bincount(row, miss[at, j] * weight, SIZE)
                grad_lex[:, j] = np.bincount(lex, miss[:, j], L + 1)
            n = len(part)
            for value, grad, square in zip(
                (model.table, model.lexicon_weight, model.move, model.first), (grad_table, grad_lex, step, miss[chains.start].sum(0)), squares, strict=True
            ):
                grad = grad / n - decay * value
                square += grad * grad
                value += rate * grad / np.sqrt(square)
    return model


def has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def labelling(shipped, runs: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shipped.value
        L = len(m.labels)
        plain = np.zeros(256, bool)
        plain[[*range(65, 91), *range(97, 123)]] = True
        for batch in slices(batches, 1 << 20):
            data, offsets = buffer_of(batch["text"])
            w, gamma = m.label_words(data, offsets)
            total = np.concatenate([np.zeros((1, L)), np.cumsum(gamma, 0)])
            n = np.maximum(np.diff(w.first), 1)
            share = (total[w.first[1:]] - total[w.first[:-1]]) / n[:, None]
            ascii_ = np.concatenate([[0], np.cumsum(plain[data])])
            sure = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
            best = share.argmax(1) if L else np.zeros(batch.num_rows, int)
            langs, scores = [], []
            for d in range(batch.num_rows):
                known = L and (sure[d] or has_letter(data[offsets[d] : offsets[d + 1]].tobytes()))
                langs.append(m.labels[best[d]] if known else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, share[d, best[d]]))) if known else 0.0)
            names = carried(batch.schema.names)
            made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if runs:
                made.append(pa.array(list(word_runs(w, gamma, m.labels)), RUNS))
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in names], *made], [*names, "lang_pred", "score", *["runs"] * runs])

    return label


RUNS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def word_runs(w: Words, gamma: np.ndarray, labels: list[str]) -> Iterator[list[dict]]:
    """Stretches of words [start, end) with one likeliest label, text by text."""
    best = gamma.argmax(1) if len(gamma) else np.zeros(0, int)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        own = best[a:b]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
        ends = np.concatenate([at[1:], [len(own)]]) if len(at) else at
        yield [{"label": labels[own[s]], "start": int(s), "end": int(e)} for s, e in zip(at, ends, strict=True)]


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 150, **options) -> Model:
    """Fits on whole texts with a language: at most ``sample_docs`` of each language, the least by a hash of id and text.

    That bound is the only one: the lexicons and weights of a model need no more
    rows as the table grows. Rows without text or language are left out. The
    number of languages must be small (it sets the size of the model).
    """
    d = docs.select(c(id_col).alias("id"), c(text_col).alias("text"), c(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) > 1000:
        raise ValueError(f"{len(counts)} languages: not a language column")
    # a hash range that holds the wanted rows of each language with room to spare
    grain = 1 << 30
    limit = F.lit(0)
    for lang, n in counts.items():
        share = min(1.0, (2 * sample_docs + 50) / n)
        limit = F.when(F.col("lang") == lang, int(share * grain)).otherwise(limit)
    key = F.xxhash64(F.col("id").cast("string"), "text")
    rows = d.where(F.pmod(key, F.lit(grain)) < limit).select("lang", F.pmod(key, F.lit(grain)).alias("k"), F.col("text").cast("binary").alias("text")).collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["k"], bytes(r["text"]))):
        got = taken.setdefault(r["lang"], [])
        if len(got) < sample_docs:
            got.append(bytes(r["text"]))
    pairs = [(t, lang) for lang, texts in taken.items() for t in texts]
    return train([t for t, _ in pairs], [x for _, x in pairs], **options)


def language_of(docs: DataFrame, model: Model, *keep: str, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(id, kept columns, lang_pred, score) of every row (see text.kept_column), with ``runs`` also the labelled word stretches.

    ``lang_pred`` is ``und`` with score 0 for a null text, one without a letter,
    or a model without labels. Repeated rows get equal answers; columns besides
    the id, the text and ``keep`` are not read.
    """
    d = with_kept(docs, id_col, text_col, keep)
    more = ", runs array<struct<label:string,start:bigint,end:bigint>>" if runs else ""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return d.mapInArrow(labelling(shipped, runs), f"{ddl(d)}, lang_pred string, score double{more}")


def held_out(id_col: Column, mod: int) -> Column:
    """True where crc32 of the id as text leaves remainder 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == 2


def language_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out."""
    model = fit_language_model(docs.where(~held_out(c("doc_id"), 4)), **options)
    return language_of(docs, model).select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4).alias("held_out"), "lang_pred", "score")
