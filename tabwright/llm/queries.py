"""Registered queries of the numbered operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op2_decontamination",
    rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    ), b AS (
        SELECT item_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL
    ), p AS (
        SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS gram, least(10, len(w)) AS m
        FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT m FROM p), g AS (
        SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
        FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
    ), hit AS (SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p USING (gram, m)),
    h AS (
        SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + m)) AS t(k) GROUP BY doc_id
    ), own AS (
        SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
    )
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN own USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.wumanber import contamination

    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.secrets import secret_report

    return secret_report(table(spark, sf, "documents"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.licenses import license_report

    return license_report(table(spark, sf, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.golay import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.token_files import token_file_digests

    return token_file_digests(table(spark, sf, "documents"))


@query("op9_bpe_encoding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.bpe import encoding_digests

    return encoding_digests(table(spark, sf, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.quality_rules import quality_rules

    trusted = table(spark, sf, "labels").where("quality = 1").selectExpr("doc_id AS id")
    return quality_rules(table(spark, sf, "documents"), trusted)


@query("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.crf import language_report

    return language_report(table(spark, sf, "documents"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.rules import quality_scores

    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_lm_scoring")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.maxent import lm_report

    return lm_report(table(spark, sf, "documents"))


@query(
    "op11_warc",
    r"""
    WITH p AS (
        SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
    ), d AS (
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS key, (unhex(sha1(b))::BIT)::VARCHAR AS bits,
            min(page_id) OVER (PARTITION BY sha256(b)) AS least
        FROM p
    )
    SELECT page_id, payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
            list_transform(range(0, 5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INTEGER), 1) AS INTEGER) * CAST(power(2, 4 - k) AS INTEGER))) AS INTEGER), 1)), '') AS payload_digest,
        CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN least IS NULL OR page_id = least THEN NULL ELSE least END AS refers_to, TRUE AS verified
    FROM d
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.warc import archive_digests
    from tabwright.session import scratch_path

    return archive_digests(table(spark, sf, "pages"), scratch_path(spark, "warc"))


@query(
    "op12_merkle_manifest",
    rf"""
    WITH RECURSIVE raw AS (
        SELECT doc_id, lang, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS f,
            coalesce(strlen(text)::VARCHAR || ':' || {LOWER}, '-') AS low, list_reduce([4294967295::BIGINT] ||
                list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT),
                lambda a, x: list_reduce([xor(a, x)] || list_transform(range(8), lambda y: y::BIGINT), lambda p, y: xor(p >> 1, 3988292384 * (p & 1)))) AS inv
        FROM documents
    ), l AS (
        SELECT doc_id, lang, sha256(array_to_string(f, '')) AS leaf,
            CASE WHEN xor(inv, 4294967295) % 3 = 0 THEN sha256(array_to_string(f[1:4], '') || low) ELSE sha256(array_to_string(f, '')) END AS now
        FROM raw
    ), p AS (
        SELECT doc_id, leaf, now, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size
        FROM l
    ), lv AS (
        SELECT tree, 0 AS level, idx, leaf AS h, size FROM p
        UNION ALL
        SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 7) // 8 FROM lv WHERE size > 1 GROUP BY tree, level, idx // 8
    ), tp AS (
        SELECT 0::BIGINT AS tree, 0 AS level, tree - 1 AS idx, h, count(*) OVER () AS size FROM lv WHERE size = 1
        UNION ALL
        SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(size) + 7) // 8 FROM tp WHERE size > 1 GROUP BY tree, level, idx // 8
    ), n AS (
        SELECT * FROM lv UNION ALL SELECT * FROM tp
    ), runs AS (
        SELECT tree, level, idx // 8 AS run, any_value(size) AS size, list(h ORDER BY idx) AS hs FROM n GROUP BY tree, level, idx // 8
    ), climb AS (
        SELECT doc_id, leaf, tree AS home, tree, 0 AS level, idx, now AS folded, '' AS path FROM p
        UNION ALL
        SELECT doc_id, leaf, home, CASE WHEN r.size = 1 THEN 0 ELSE k.tree END, CASE WHEN r.size = 1 THEN 0 ELSE k.level + 1 END,
            CASE WHEN r.size = 1 THEN k.tree - 1 ELSE k.idx // 8 END,
            CASE WHEN r.size = 1 THEN folded ELSE sha256(array_to_string(hs[1:k.idx % 8], '') || folded || array_to_string(hs[k.idx % 8 + 2:], '')) END,
            path || array_to_string(hs[1:k.idx % 8], '') || array_to_string(hs[k.idx % 8 + 2:], '')
        FROM climb k JOIN runs r ON r.tree = k.tree AND r.level = k.level AND r.run = k.idx // 8 WHERE k.tree > 0 OR r.size > 1
    )
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
    FROM climb k JOIN tp t ON t.size = 1 AND k.tree = 0 AND k.level = t.level JOIN lv s ON s.size = 1 AND s.tree = k.home
    """,
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.merkle import manifest_report

    return manifest_report(table(spark, sf, "documents"))


@query(
    "op13_fill_in_middle",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), u AS (
        SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
            ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS s
        FROM d
    ), f AS (
        SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM u
    ), o AS (
        SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS q FROM f
    )
    SELECT doc_id, n, form, CASE WHEN form = 'plain' THEN NULL ELSE a END AS prefix_chars, CASE WHEN form = 'plain' THEN NULL ELSE b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM o
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from tabwright.llm.frames import fim_digests

    return fim_digests(table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
