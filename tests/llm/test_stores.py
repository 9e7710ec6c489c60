"""WARC archives, Merkle manifests and framed texts: contracts, round trips, damage and awkward rows."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabwright.llm import frames, merkle, warc
from tabwright.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_contracts import check, documents
from tests.oracle import compare, connect

CONTRACT = {
    "op11_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op12_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}


@pytest.fixture(params=["shared", "edge"])
def sf_dir(request, edge):
    return SMALL if request.param == "shared" else edge


def rows_of(sf, table, *columns):
    t = pq.read_table(f"{sf}/{table}.parquet")
    return list(zip(*(t[x].to_pylist() for x in columns), strict=True))


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) is None


def test_op11(spark, sf_dir):
    df = QUERIES["op11_warc"](spark, sf_dir).cache()
    check(df, CONTRACT["op11_warc"], brute.op11(rows_of(sf_dir, "pages", "page_id", "url", "html")))
    assert df.where("not verified").count() == 0


def test_op12(spark, sf_dir):
    rows = rows_of(sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    check(QUERIES["op12_merkle_manifest"](spark, sf_dir), CONTRACT["op12_merkle_manifest"], brute.op12(rows))


def test_op13(spark, sf_dir):
    check(QUERIES["op13_fill_in_middle"](spark, sf_dir), CONTRACT["op13_fill_in_middle"], brute.op13(documents(sf_dir)))


def test_archives_hold_whole_pages(spark, edge, tmp_path):
    """Payloads, ids and plain urls come back; other gzip readers see the same records; small bundles roll archives."""
    pages = spark.read.parquet(f"{edge}/pages.parquet")
    path = str(tmp_path / "warc")
    warc.write_archives(pages.repartition(1), path, bundle_bytes=300)
    got = warc.read_archives(spark, path).cache()
    assert got.where("problem is not null").count() == 0
    assert got.select("archive").distinct().count() > 1
    back = got.where("record_type = 'response'").select("page_id", F.col("payload").cast("string")).collect()
    want = {html or "" for _, _, html in rows_of(edge, "pages", "page_id", "url", "html")}
    assert {r["payload"] for r in back} == want
    assert got.where("record_type = 'revisit' and payload is not null").count() == 0
    ids = {(r["page_id"], r["url"]) for r in got.where("record_type <> 'warcinfo'").collect()}
    assert {(9, "u%2541"), (3, None), (7, "http://a/%C3%BC%20b%0D%0AX:%20y"), (None, "w")} <= ids
    for f in (tmp_path / "warc").glob("part-*"):
        plain = gzip.decompress(f.read_bytes())
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and plain.endswith(b"\r\n\r\n")


def test_text_ids_and_extra_columns(spark, tmp_path):
    pages = spark.createDataFrame([("b\n1", "x", {"k": 1}), ("a%", "x", None), (None, "x", None)], "name string, body string, page_id map<string,int>")
    warc.write_archives(pages, str(tmp_path / "w"), "name", None, "body")
    got = warc.read_archives(spark, str(tmp_path / "w"), "string").where("record_type <> 'warcinfo'").select("page_id", "record_type", "refers_to", "url").collect()
    assert sorted(map(tuple, got), key=repr) == [("a%", "response", None, None), ("b\n1", "revisit", "a%", None), (None, "revisit", "a%", None)]


def test_a_long_record_ends_with_an_empty_member():
    noise = random.Random(1).randbytes(1 << 16)
    long = warc.member(noise * 300)
    assert long[-1] == 0 and gzip.decompress(long) == noise * 300
    assert warc.member(b"x")[-1] == 0
    made = warc.member(warc.record("response", "1", "u", noise * 300, None, "d")) + warc.member(warc.record("response", "2", "u", b"next", None, "d"))
    assert [(r["page"], r["payload_bytes"], r["problem"]) for r in warc.read_records(made, False)] == [("1", 300 << 16, None), ("2", 4, None)]


def test_damage_is_found_and_passed():
    parts = [warc.member(warc.record("response", str(i), "u", f"page {i} {'x' * 200}".encode(), None, "d")) for i in range(6)]
    ids = lambda data: [(r["page"], r["problem"] is None) for r in warc.read_records(data)]
    assert ids(b"".join(parts)) == [(str(i), True) for i in range(6)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 255
    got = ids(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
    assert (None, False) in got and [x for x in got if x[1]] == [(str(i), True) for i in (0, 1, 3, 4, 5)]
    assert ids(b"".join(parts)[:-30])[-1] == (None, False)
    forged = warc.member(warc.record("response", "9", "u", b"true text", None, "d").replace(b"true text", b"tr0e text"))
    assert [r["problem"] for r in warc.read_records(forged + parts[0])] == ["block digest", None]
    short = warc.member(warc.record("response", "9", "u", b"true text", None, "d")[:-9])
    long = warc.member(warc.record("response", "9", "u", b"true text", None, "d").replace(b"true text", b"true text and more"))
    assert all(r["problem"] for r in warc.read_records(short)) and [r["page"] for r in warc.read_records(long + parts[0])][-1] == "0"
    together = warc.member(warc.record("response", "1", None, b"a", None, "d") + warc.record("revisit", "2", None, b"a", "1", "d"))
    assert [(r["page"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_records(together)] == [("1", "response", 1, None), ("2", "revisit", 1, "1")]
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [(r["record_type"], r["payload"]) for r in warc.read_records(gzip.compress(plain))] == [("resource", b"hello")]
    assert [r["problem"] is None for r in warc.read_records(b"not an archive")] == [False] and list(warc.read_records(b"")) == []


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 65, 1], [3] * 20, [600]])
def test_trees_of_every_height(spark, sizes):
    rows = [(100 * g + i, "s", f"g{g:02d}" if g else None, i, f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    check(merkle.manifest_report(docs), CONTRACT["op12_merkle_manifest"], brute.op12(rows))


def test_equal_leaves_and_null_ids(spark):
    rows = [(1, "s", "en", 3, "Same")] * 40 + [(None, None, None, None, None)] * 10 + [(None, "s", "en", 1, "Other")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    check(merkle.manifest_report(docs), CONTRACT["op12_merkle_manifest"], brute.op12(rows))


def test_numbers_without_a_window_over_all(spark):
    d = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = merkle.numbered(d, ["g"], ["v"], "places").collect()
    for g in range(3):
        mine = sorted((r["idx"], r["v"]) for r in got if r["g"] == g)
        assert [i for i, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_frames_open_only_where_they_are_cut():
    text = "".join(random.Random(2).choices("aé日😀 ", k=1000))
    batch = next(frames.framing(64)(iter([pa.RecordBatch.from_pydict({"id": [1], "text": [text.encode()]})])))
    stored = batch.to_pylist()[0]
    assert stored["counts"] == [*range(0, 1000, 64), 1000] and len(stored["frames"]) == 16
    for a, b in [(0, 0), (0, 1000), (63, 64), (64, 128), (100, 101), (999, 1000), (1000, 1000), (5, 700)]:
        f = frames.Frames(stored["frames"], np.array(stored["counts"]))
        start, end = f.seek(a), f.seek(b)
        assert f.opened == (a % 64 > 0 and a < 1000) + (b % 64 > 0 and b < 1000)
        assert b"".join(f.stream(start, end)).decode() == text[a:b]


def test_outputs_of_many_frames(spark):
    rng = random.Random(3)
    docs = [(i, "".join(rng.choices("aé日😀 <PSM>", k=rng.randrange(0, 300)))) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = frames.fill_in_middle(frames.store_frames(d, units=16)).withColumnRenamed("id", "doc_id").cache()
    check(got, CONTRACT["op13_fill_in_middle"], brute.op13(docs))
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    for r in got.collect():
        assert brute.sha(r["output"]) == r["output_sha256"]
        assert b"".join(frames.restored(r["output"].encode(), r["form"])).decode() == dict(docs)[r["doc_id"]]


def test_the_writer_copies_few_rows_of_a_batch_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from tabwright.llm import warc

    n = 1500
    rows = {"page": [str(i) for i in range(n)], "url": ["u"] * n, "payload": [bytes([i % 251]) * 20_000 for i in range(n)], "first": [None] * n}
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([("page", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("first", pa.string())]))
    del rows
    tracemalloc.start()
    try:
        written = sum(out.num_rows for out in warc.archiving("1970-01-01T00:00:00Z", 1 << 16)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert written and peak < 6_000_000  # the payloads are 30 MB
