"""Secret scans: known key formats plus sliding-window entropy over candidate strings.

Candidates are long unbroken strings. Per character class a window moves over the
string with its character counts kept up to date, one out and one in, so each step
costs the same whatever the window. Windows at or above the class's entropy are
joined into a span. What a known format covers is cut from the span; a rest that
the allow list matches nearly whole, or that reads like words, is suppressed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.text import buffer_of, carried, ddl, kept_column, slices, with_kept

KINDS = ("assign", "access", "hex", "entropy")
#: The known formats. Bytes patterns, so "either case" means ASCII letters only.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")

#: class -> (its characters, window, least bits of entropy a window must have)
CLASSES = {
    "hex": (re.compile(rb"[0-9a-f]+|[0-9A-F]+"), 24, 3.2),
    "base64": (re.compile(rb"[A-Za-z0-9+/_-]+={0,2}"), 20, 3.9),
}
#: Listed strings, each by itself: ids, placeholder words, and words joined by separators.
ALLOW = (
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(rb"(?i)(?:example|sample|dummy|placeholder|changeme|your|x{4,}|1234567(?:89?0?)?|abcdef(?:g(?:hi?)?)?|lorem|key|secret|token|[-_])+"),
    re.compile(rb"[-_/.+]?(?:[A-Z]?[a-z]+[-_/.+]+)*[A-Z]?[a-z]+[-_/.+]?\d{0,4}"),
)
#: a word that marks the letters and digits it is joined to as no secret; what a separator parts from it is looked at
MARKED = re.compile(rb"(?i)[a-z0-9]*(?:example|sample|dummy|placeholder|changeme|lorem)[a-z0-9]*")
#: a checksum says what it is
CHECKSUM = re.compile(rb"(?i)sha\d*[-:=]")
#: share of a span that listed strings must match to suppress it
LISTED = 0.8
#: fewest characters of a span's part beside a known format
LEAST_PART = 8
CANDIDATE = np.zeros(256, bool)
CANDIDATE[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", np.uint8)] = True
SHORTEST = min(w for _, w, _ in CLASSES.values())


def entropic(text: bytes, window: int, bits: float) -> list[tuple[int, int]]:
    """Joined spans of the windows whose Shannon entropy is at least ``bits``."""
    n = len(text)
    if n < window:
        return []
    term = [0.0] + [k * math.log2(k) for k in range(1, window + 1)]
    counts = [0] * 256
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        k = counts[ch]
        total += term[k + 1] - term[k] if k < window else 0.0
        counts[ch] = k + 1
        if i < window - 1:
            continue
        if math.log2(window) - total / window >= bits - 1e-12:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
        old = text[i - window + 1]
        k = counts[old]
        total += term[k - 1] - term[k]
        counts[old] = k - 1
    return out


KIND_OF = np.zeros(256, np.int8)
KIND_OF[ord("a") : ord("z") + 1] = 1
KIND_OF[ord("A") : ord("Z") + 1] = 2
KIND_OF[ord("0") : ord("9") + 1] = 3


def mixes(text: bytes) -> bool:
    """Letters with two digits or more, or kinds of character that change too often for words."""
    kind = KIND_OF[np.frombuffer(text, np.uint8)]
    if not ((kind == 1) | (kind == 2)).any():
        return False
    changes = np.count_nonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0))
    return np.count_nonzero(kind == 3) >= 2 or 5 * changes >= 2 * len(text)


def listed(text: bytes) -> bool:
    """Whether strings of one pattern of the allow list make up (nearly) all of ``text``."""
    return any(sum(m.end() - m.start() for m in p.finditer(text) if m.end() - m.start() >= 4) >= LISTED * len(text) for p in ALLOW)


def uncovered(a: int, b: int, known: list[list[int]]) -> list[tuple[int, int]]:
    """The parts of [a, b) outside sorted, disjoint spans."""
    out = []
    for s, e in known[bisect_right(known, a, key=lambda k: k[1]) :]:
        if s >= b:
            break
        if a < s:
            out.append((a, s))
        a = max(a, e)
    if a < b:
        out.append((a, b))
    return out


def method_spans(run: bytes, known: list[list[int]] = ()) -> list[tuple[int, int]]:
    """Spans in one candidate string that look random; ``known`` are the places in it of known formats."""
    if CHECKSUM.match(run):
        return []
    found: list[tuple[int, int]] = []
    for chars, window, bits in CLASSES.values():
        for m in chars.finditer(run):
            if m.end() - m.start() >= window:
                found += [(m.start() + a, m.start() + b) for a, b in entropic(m[0], window, bits)]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    # ids and marked strings stand for themselves; what is beside them is looked at alone
    ids = [[m.start(), m.end()] for p in (ALLOW[0], MARKED) for m in p.finditer(run)]
    cut = merged(sorted([*map(list, known), *ids]))
    return [
        (x, y) for a, b in joined for x, y in uncovered(a, b, cut)
        if (y - x >= LEAST_PART) and mixes(run[x:y]) and not listed(run[x:y])
    ]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans with overlapping ones made one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def known_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, leftmost non-overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the candidate runs of a whole batch; a run ends with its text."""
    inside = CANDIDATE[data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:n]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = {k: i for i, k in enumerate(KINDS)}
    for batch in slices(batches):
        texts = batch["text"].to_pylist()
        data, offsets = buffer_of(batch["text"])
        spans = [known_spans(t) for t in texts]
        taken = [merged(sorted([s, e] for s, e, _ in x)) for x in spans]
        for a, b in zip(*candidates(data, offsets), strict=True):
            d = int(np.searchsorted(offsets, a, "right")) - 1
            at = int(a - offsets[d])
            first, end = (bisect_right(taken[d], v, key=k) for v, k in ((at, lambda s: s[1]), (at + int(b - a) - 1, lambda s: s[0])))
            inside = [[max(s - at, 0), e - at] for s, e in taken[d][first:end]]
            spans[d] += [(x + at, y + at, "entropy") for x, y in method_spans(data[a:b].tobytes(), inside)]
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found:
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                found = [{"kind": k, "start": int(points[a]), "end": int(points[b])} for a, b, k in found]
                found.sort(key=lambda s: (s["start"], rank[s["kind"]], s["end"]))
            out.append(found)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        names = carried(batch.schema.names)
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(out, kind)], [*names, "spans"])


def secret_spans(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept columns, spans) of every row (see text.kept_column); spans are (kind, start, end) in code points, by start, then kind.

    Kinds are assign, access and hex (known formats) and entropy (the method's
    own, cut where a known one lies). Work grows with the text, however many
    spans it has and however long it is. A null or empty text has none; repeated
    rows are scanned each; only the id, the text and ``keep`` are read.
    """
    d = with_kept(docs, id_col, text_col, keep)
    return d.mapInArrow(scan, f"{ddl(d)}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def said(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; see secret_spans."""
    found = secret_spans(docs, **options)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``mark``; texts without a span stay as they are.

    Overlapping spans are replaced together. Columns and their order are kept; a
    null text stays null.
    """
    found = secret_spans(docs, *docs.columns, id_col=id_col, text_col=text_col)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    whole = F.col("text").cast("string")

    def step(a, s):
        text = F.concat(a["done"], F.substring(whole, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit(mark))
        fresh = s["start"] >= a["at"]
        return F.struct(F.when(fresh, text).otherwise(a["done"]).alias("done"), F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["done"], F.substring(whole, a["at"] + 1, F.length(whole))))
    text = F.when(F.size("spans") > 0, done).otherwise(kept_column(text_col, text_col)).alias(text_col)
    return found.select(*[text if x == text_col else kept_column(x, text_col) for x in docs.columns])
