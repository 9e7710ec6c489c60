"""Every query against brute force, on the shared small tables and on awkward rows."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabwright.llm.bpe import default_path
from tabwright.llm.crf import held_out
from tabwright.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.llm import brute
from tests.oracle import compare, connect

NAMES = {n.split("_")[0]: n for n in QUERIES if n.startswith("op")}


def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def check(df, columns, want):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3] == []


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


@pytest.fixture(params=["shared", "edge"])
def sf_dir(request, edge):
    return SMALL if request.param == "shared" else edge


def test_op1(spark, sf_dir):
    df = QUERIES[NAMES["op1"]](spark, sf_dir).cache()
    want = brute.op1(documents(sf_dir))
    check(df, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"], [w[:5] for w in want])
    got = sorted((r["doc_id"], r["base_score"]) for r in df.collect())
    for (a, x), (b, y) in zip(got, sorted((w[0], w[5]) for w in want), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-9)
    assert df.where("score > 0 or score is null or isnan(score)").count() == 0


def test_op2(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/benchmark.parquet")
    want = brute.op2(documents(sf_dir), list(zip([None if i is None else i for i in t["item_id"].to_pylist()], t["text"].to_pylist(), strict=True)))
    df = QUERIES[NAMES["op2"]](spark, sf_dir)
    if sf_dir == SMALL:
        assert compare(df, connect(sf_dir), SQL[NAMES["op2"]]) is None
        check(df, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], want)
    else:  # the item without an id marks words but is not listed
        check(df, ["doc_id", "n_words", "n_hit", "contaminated"], [(*w[:3], w[5]) for w in want])


def test_op4(spark, sf_dir):
    check(QUERIES[NAMES["op4"]](spark, sf_dir), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], brute.op4(documents(sf_dir)))


def test_op5(spark, sf_dir):
    check(QUERIES[NAMES["op5"]](spark, sf_dir), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], brute.op5(documents(sf_dir)))


def test_op6(spark, sf_dir):
    check(QUERIES[NAMES["op6"]](spark, sf_dir), ["doc_id", "fingerprint", "component_id"], brute.op6(documents(sf_dir)))


def test_op7(spark, sf_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = QUERIES[NAMES["op7"]](spark, sf_dir).cache()
    check(df, columns, brute.op7(documents(sf_dir)))
    assert df.where("kept is null or (base_failed and kept)").count() == 0


def test_op8(spark, sf_dir, tokenizer):
    docs = documents(sf_dir)
    df = QUERIES[NAMES["op8"]](spark, sf_dir).cache()
    if sf_dir == SMALL:
        check(df, ["doc_id", "start", "n_tokens", "ids_crc32"], brute.op8(docs, tokenizer))
    else:  # repeated ids may stand in either order
        want = brute.op8(docs, tokenizer)
        check(df, ["doc_id", "n_tokens", "ids_crc32"], [(w[0], *w[2:]) for w in want])
        rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in df.collect())
        assert [r[1] for r in rows] == sorted(d[0] for d in docs)
        assert all(a[0] + a[2] == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][0] == 0


def test_op9(spark, sf_dir, tokenizer):
    check(QUERIES[NAMES["op9"]](spark, sf_dir), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], brute.op9(documents(sf_dir), tokenizer))


def test_op3_and_op10_give_a_row_each(spark, sf_dir):
    docs = documents(sf_dir)
    df = QUERIES[NAMES["op3"]](spark, sf_dir).cache()
    check(df, ["doc_id", "held_out"], [(i, brute.held_out(i, 4)) for i, _ in docs])
    assert df.where("score is null or score < 0 or score > 1 or lang_pred is null").count() == 0
    none = {i for i, t in docs if not any(ch.isalpha() for ch in t or "")}
    assert {r["doc_id"] for r in df.where("lang_pred = 'und'").collect()} == none
    df = QUERIES[NAMES["op10"]](spark, sf_dir).cache()
    check(df, ["doc_id", "held_out"], [(i, brute.held_out(i, 4)) for i, _ in docs])
    assert df.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_null_id_is_not_held_out(spark):
    assert spark.sql("select cast(null as bigint) id").select(held_out(F.col("id"), 7)).first()[0] is False


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_awkward_rows(spark, edge, tokenizer):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = sorted((tuple(r)[:2] for r in dict(corpus_pipeline.STAGES)["bpe_encoding"](spark, docs, edge).collect()), key=repr)
    assert docs.count() > 0 and ids == sorted(((r["doc_id"], len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect()), key=repr)


def test_pipeline_against_brute_force(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    lang = stages["language_id"](spark, docs, SMALL)
    kept = rows(lang)
    assert set(kept) <= set(rows(docs)) and len(kept) >= 0.97 * docs.count()
    lang = spark.createDataFrame(kept, docs.schema)
    texts = [(r[0], r[1]) for r in kept]
    want = brute.near_kept(texts)
    near = stages["near_dedup"](spark, lang, SMALL)
    assert [r[0] for r in sorted(rows(near), key=lambda r: r[0])] == want
    near = spark.createDataFrame(rows(near), docs.schema)
    t = pq.read_table(f"{SMALL}/benchmark.parquet")
    hit = {w[0] for w in brute.op2([(r[0], r[1]) for r in near.collect()], list(zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True))) if w[5]}
    clean = stages["decontamination"](spark, near, SMALL)
    assert hit and rows(clean) == [r for r in rows(near) if r[0] not in hit]
    clean = spark.createDataFrame(rows(clean), docs.schema)
    safe = stages["secret_scan"](spark, clean, SMALL)
    before = {r[0]: r for r in rows(clean)}
    found = {x[0]: sum(x[1:4]) for x in brute.op4([(r[0], r[1]) for r in before.values()])}
    for r in rows(safe):
        assert r[4] == len(r[1])
        assert ("[secret]" in r[1]) if found[r[0]] else True
        assert r == before[r[0]] or "[secret]" in r[1]
    assert not any(sum(x[1:4]) for x in brute.op4([(r[0], r[1]) for r in rows(safe)]))
    safe = spark.createDataFrame(rows(safe), docs.schema)
    ids = {r["doc_id"]: r for r in stages["bpe_encoding"](spark, safe, SMALL).collect()}
    assert len(ids) == safe.count()
    for r in safe.collect():
        assert ids[r["doc_id"]]["ids"] == tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert ids[r["doc_id"]]["round_trip"] and ids[r["doc_id"]]["n_tokens"] == len(ids[r["doc_id"]]["ids"])
