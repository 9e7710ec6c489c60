"""SimHash near-duplicates linked through Golay-code keys.

A fingerprint's 64 bits fall into three segments of 23, 23 and 18 bits. Two
fingerprints at most two bits apart have a segment without an error whose
follower (in a circle) has at most one. So each follower is decoded to the
nearby codewords of the perfect (23, 12) Golay code - its own and those of its
one-bit neighbours, one or a few indices - and every index is joined with the
exact bits of the segment before it into a key. One of two such fingerprints
lies in the other's ball, so they share the key of its codeword. Fingerprints that
share a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.exprs import c
from tabwright.llm.text import id_and_text, slices
from tabwright.operators.components import connected_components
from tabwright.session import write_through

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the Golay code.
GENERATOR = 0b110001110101
#: (first bit, bits) of each segment
SEGMENTS = ((0, 23), (23, 23), (46, 18))
DISTANCE = 2
#: a key shared by more fingerprints than this is settled through midpoints, not pairs
PAIRED = 64


def remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainders by low 12 and high 11 bits, error pattern of each of the 2,048 remainders)."""
    bits = np.array([remainder(1 << i) for i in range(23)], np.int64)
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[(np.arange(1 << 12) >> i & 1) == 1] ^= bits[i]
    for i in range(11):
        high[(np.arange(1 << 11) >> i & 1) == 1] ^= bits[12 + i]
    error = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for places in combinations(range(23), n):
            at = 0
            for p in places:
                at ^= int(bits[p])
            error[at] = sum(1 << p for p in places)
    return np.concatenate([low, high]), error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    rest, error = tables()
    syndrome = rest[words & 0xFFF] ^ rest[(1 << 12) + (words >> 12)]
    return (words ^ error[syndrome]) >> 11


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every key of unsigned fingerprints."""
    parts = [((fingerprints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        flips = np.concatenate([[0], 1 << np.arange(SEGMENTS[j][1])])
        index = np.sort(codeword_index(parts[j][:, None] ^ flips), axis=1)
        fresh = np.ones(index.shape, bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        keys.append((np.int64(i) << 35) | (parts[i][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprinting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        got = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(got)], [*names, "fp"])


def fingerprints(docs: DataFrame, *more, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ..., fp) of every row; fp holds the unsigned 64 bits as a long."""
    d = id_and_text(docs, id_col, text_col, *more)
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    return d.mapInArrow(fingerprinting, f"{rest}, fp bigint")


def keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 8192):
            fp = batch["fp"].slice(a, 8192).to_numpy(zero_copy_only=False)
            row, key = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what is at most two bits apart among the members of one key."""
    n = len(members)
    u = members.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u) <= DISTANCE
    left, out = set(range(1, n)), []
    todo = [0]
    while todo or left:
        if not todo:
            todo = [left.pop()]
        x = todo.pop()
        for y in [y for y in left if near[x, y]]:
            left.remove(y)
            todo.append(y)
            out.append((int(members[x]), int(members[y])))
    return out


def verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links: list[tuple[int, int]] = []
        for m in batch["members"]:
            links += forest(m.values.to_numpy(zero_copy_only=False))
        made = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])


def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            fp = batch["fp"].slice(a, 4096).to_numpy(zero_copy_only=False)
            hub = (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(np.repeat(fp, 65))], ["hub", "fp"])


def links_between(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly what chains of fingerprints at most two bits apart connect.

    Keys with up to ``PAIRED`` fingerprints are verified as they are. The
    fingerprints of fuller keys (a large group of near copies) each visit their
    65 midpoints, the values at most one bit away: two fingerprints at most two
    bits apart meet at one, all that meet at one are at most two apart, and no
    more than 65 can meet, so such a group costs its size, not its square.
    """
    keyed = write_through(distinct.mapInArrow(keying, "key bigint, fp bigint"), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = write_through(keyed.join(sizes, "key"), "golay-shared")
    paired = shared.where(F.col("n") <= PAIRED).groupBy("key").agg(F.collect_set("fp").alias("members"))
    near = paired.select("members").mapInArrow(verifying, "a bigint, b bigint")
    full = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    met = full.mapInArrow(midpoints, "hub bigint, fp bigint").groupBy("hub").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return near.unionByName(stars).distinct()


def near_groups(prints: DataFrame, more_links: DataFrame | None = None) -> DataFrame:
    """(fp, component): the least fingerprint reachable from each distinct one, also over ``more_links`` (a, b) if given."""
    distinct = prints.select("fp").distinct()
    links = links_between(distinct)
    links = write_through(links if more_links is None else links.unionByName(more_links).distinct(), "golay-links")
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    found = connected_components(nodes, links).select(F.col("id").alias("fp"), "component")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints of 3-word shingles link at two or fewer differing bits;
    ``component_id`` is the least id reachable. Texts without words have
    fingerprint zero and link like any other. Rows with a null id count for
    linking; a group of such rows alone has a null ``component_id``. Repeated rows
    are kept; columns besides the id and the text stay behind.
    """
    prints = write_through(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    grouped = write_through(near_groups(prints).join(least, "fp"), "simhash-groups")
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    found = grouped.join(names, "component").select("fp", "component_id")
    return prints.join(found, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_hash(docs: DataFrame, as_text: tuple[str, ...] = ()) -> Column:
    """A 64-bit hash of all columns of a row; maps, which have no hash, go by their JSON."""
    plain = [c(f.name).cast("string") if f.name in as_text else c(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    maps = [F.to_json(F.struct(c(f.name).alias("m"))) for f in docs.schema if "map<" in f.dataType.simpleString()]
    return F.xxhash64(*plain, *maps)


def unused(stem: str, names: list[str]) -> str:
    """``stem``, with underscores until no column is called so in any case."""
    taken = {n.lower() for n in names}
    while stem in taken:
        stem += "_"
    return stem


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row kept of each group that ``near_duplicates`` links: the least id, then the least row hash.

    Columns and their order are kept, whatever their names and types. Of wholly
    equal rows one stays. A null id comes after all others of its group. Texts
    without words (null, empty, only blanks) are one group. Texts of any length
    are read whole; an empty table stays empty.
    """
    name = F.coalesce(c(id_col).cast("string"), F.lit(""))
    row = row_hash(docs, (id_col,))
    prints = write_through(fingerprints(docs, name.alias("name"), row.alias("row"), id_col=id_col, text_col=text_col), "simhash-rows")
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "name", "row")).alias("best"))
    first = near_groups(prints).join(best, "fp").groupBy("component").agg(F.min("best").alias("best"))
    by = [unused(x, docs.columns) for x in ("kept_name", "kept_row")]
    winners = first.select(F.col("best.name").alias(by[0]), F.col("best.row").alias(by[1])).distinct()
    named = docs.select(*[c(x) for x in docs.columns], name.alias(by[0]), row.alias(by[1]))
    return named.join(winners, by, "left_semi").dropDuplicates(by).select(*[c(x) for x in docs.columns])
