"""CSV, Parquet and JSON in and out; dataset versions and run archives as partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.exprs import c, parse_number
from tabwright.operators.profile import null_tokens

# Byte-order marks and the encodings they announce.
BYTE_ORDER_MARKS = {
    b"\xef\xbb\xbf": "utf-8-sig",
    b"\xff\xfe": "utf-16",
    b"\xfe\xff": "utf-16",
}


#: bytes of a file judged at a time
PIECE_BYTES = 1 << 24


def guess_encoding(raw: bytes, marked: bool = True) -> str:
    """Charset of a file's content, or of a piece of it (not ``marked``); utf-8 when nothing better is known."""
    for mark, name in BYTE_ORDER_MARKS.items() if marked else ():
        if raw.startswith(mark):
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import detect
    except ImportError:
        return "cp1252"
    return (detect(raw) or {}).get("encoding") or "utf-8"


def _judged_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, start, value) lines in file order -> one row per piece: (file, head, encoding, n), n its bytes with line ends.

    ``head`` is the encoding a byte-order mark announces, on a file's first piece only.
    """
    at, lines, size, first = None, [], 0, True

    def piece() -> pd.DataFrame:
        raw = b"\n".join(lines)
        marks = [name for mark, name in BYTE_ORDER_MARKS.items() if raw.startswith(mark)]
        head = marks[0] if first and at[1] == 0 and marks else None
        return pd.DataFrame({"file": [at[0]], "head": [head], "encoding": [guess_encoding(raw, marked=False)], "n": [size]})

    for batch in batches:
        for file, start, value in zip(batch["file"], batch["start"], batch["value"], strict=True):
            if at != (file, start) or size + len(value) > PIECE_BYTES:
                if lines:
                    yield piece()
                at, lines, size, first = (file, start), [], 0, at != (file, start)
            lines.append(value)
            size += len(value) + 1
    if lines:
        yield piece()


def detect_file_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) for every file below ``path``, judged in pieces of whole lines; a large file is many tasks' work.

    A byte-order mark decides; else a file is utf-8 if every piece is, or what
    most bytes of its other pieces are taken for.
    """

    def read(kind: str):
        return spark.read.format(kind).option("recursiveFileLookup", True)

    # the content is not among the columns and so never read here
    files = read("binaryFile").load(path).select("path", "length", F.col("_metadata.file_path").alias("file"))
    lines = read("text").option("lineSep", "\n").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )
    pieces = lines.mapInPandas(_judged_pieces, "file string, head string, encoding string, n bigint")
    votes = pieces.groupBy("file", "encoding").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    other = F.when(F.col("encoding") != "utf-8", F.struct("n", "encoding"))
    found = votes.groupBy("file").agg(F.max("head").alias("head"), F.max(other)["encoding"].alias("other"), F.sum("n").alias("n"))
    # the line reader drops the mark of utf-8: then the lines fall short of the file's length
    packed = F.lower("path").rlike(r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$")
    short = F.when((F.coalesce("n", F.lit(0)) <= F.col("length") - 2) & ~packed & F.col("head").isNull(), "utf-8-sig")
    return files.join(found, "file", "left").select("path", F.coalesce("head", short, "other", F.lit("utf-8")).alias("encoding"))


def read_table_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str | None = None,
    schema: str | None = None,
    clean_tokens: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header row; types inferred unless a schema is given.

    ``multiline`` reads quoted line breaks, at the price of one task per file.
    Give ``schema`` in production: inference reads the text twice. Missing-value
    texts become NULL before types are inferred, except in a given schema.
    """
    # line ends of wide characters cannot be found by single bytes
    wide = (encoding or "").lower().startswith(("utf-16", "utf-32"))
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding or "utf-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline or wide)
    )
    paths = [path] if isinstance(path, str) else list(path)
    if schema is not None:
        return reader.schema(schema).csv(paths)
    text = reader.csv(paths)
    if not clean_tokens:
        return text
    return infer_text_types(text)


# Encodings Spark reads itself, under its names.
NATIVE_ENCODINGS = {
    "utf-8": "utf-8",
    "utf-8-sig": "utf-8",
    "ascii": "utf-8",
    "utf-16": "utf-16",
    "utf-16le": "utf-16le",
    "utf-16be": "utf-16be",
    "utf-32": "utf-32",
    "iso-8859-1": "iso-8859-1",
    "latin-1": "iso-8859-1",
}


def redecode(df: DataFrame, encoding: str) -> DataFrame:
    """Text that was read byte by byte (iso-8859-1), decoded again in its true encoding."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.str.encode("latin-1").str.decode(encoding)

    names = [x.encode("latin-1").decode(encoding) for x in df.columns]
    return df.select(*[decode(c(x)).alias(n) for x, n in zip(df.columns, names, strict=True)])


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV below ``path`` in its own encoding; one read per encoding found."""
    by_encoding = (
        detect_file_encoding(spark, path).groupBy("encoding").agg(F.collect_list("path").alias("p"))
    )
    out: DataFrame | None = None
    for row in by_encoding.orderBy("encoding").collect():
        found = row["encoding"].lower()
        name = NATIVE_ENCODINGS.get(found)
        part = read_table_csv(spark, row["p"], name or "iso-8859-1", clean_tokens=False)
        if name is None:
            part = redecode(part, found)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return infer_text_types(out)


def infer_text_types(text: DataFrame) -> DataFrame:
    """Text columns to bigint, double or boolean where every present value parses."""
    clean = null_tokens(text)
    facts = []
    for i, name in enumerate(clean.columns):
        v = F.trim(c(name))
        facts += [
            F.bool_and(v.isNull() | v.rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"i{i}"),
            F.bool_and(v.isNull() | parse_number(v).isNotNull()).alias(f"d{i}"),
            F.bool_and(v.isNull() | F.lower(v).isin("true", "false")).alias(f"b{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    row = clean.agg(*facts).first()

    def typed(i: int, name: str):
        v = F.trim(c(name))
        if row[f"n{i}"] == 0 or row[f"d{i}"] and not row[f"i{i}"]:
            return v.cast("double").alias(name)
        if row[f"i{i}"]:
            return v.cast("bigint").alias(name)
        if row[f"b{i}"]:
            return (F.lower(v) == "true").alias(name)
        return c(name)

    return clean.select(*[typed(i, n) for i, n in enumerate(clean.columns)])


def write_table_csv(df: DataFrame, path: str, index: str | None = None) -> None:
    """CSV with header; ``index`` names a column written first, or None to leave it out."""
    columns = [x for x in df.columns if x != index]
    out = df.select(*([c(index)] if index else []), *[c(x) for x in columns])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", '""'
    ).csv(path)


def save_original(df: DataFrame, root: str, report_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/original/report_id={report_id}")


def save_prepared(df: DataFrame, root: str, report_id: str) -> None:
    """Prepared version beside the untouched original."""
    df.write.mode("overwrite").parquet(f"{root}/prepared/report_id={report_id}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def load_prepared(spark: SparkSession, root: str, report_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/prepared/report_id={report_id}")


def load_original(spark: SparkSession, root: str, report_id: str) -> DataFrame:
    """The original; the working copy where no original was kept."""
    path = f"{root}/original/report_id={report_id}"
    return spark.read.parquet(path) if path_exists(spark, path) else load_prepared(spark, root, report_id)


def write_json_doc(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one per line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_run(df: DataFrame, path: str) -> None:
    """Add a run's rows; earlier runs stay in their own partitions."""
    df.write.mode("append").partitionBy("report_id", "run_id").parquet(path)


def current_run(runs: DataFrame, by: str = "report_id", run: str = "run_id") -> DataFrame:
    """Rows of the newest run of each report (largest run id)."""
    newest = runs.groupBy(c(by)).agg(F.max(c(run)).alias(run))
    return runs.join(newest, [by, run], "left_semi")


def duplicate_dataset(df: DataFrame, report_id: str, new_id: str) -> DataFrame:
    """A report's rows under a new id, to be appended to the dataset table."""
    return df.where(F.col("report_id") == report_id).withColumn("report_id", F.lit(new_id))


def purgeable_artifacts(artifacts: DataFrame, reports: DataFrame, deleted: DataFrame) -> DataFrame:
    """Artifacts of deleted reports, keeping originals another live report shares.

    ``reports(report_id, original_filename)``, ``deleted(report_id)``,
    ``artifacts(report_id, suffix, ...)``. A report counts as sharing when any
    other report has the same original file name.
    """
    gone = reports.join(deleted, "report_id", "left_semi")
    per_name = reports.where(F.col("original_filename") != "").groupBy("original_filename").agg(
        F.count(F.lit(1)).alias("holders")
    )
    shared = gone.join(per_name.where(F.col("holders") > 1), "original_filename", "left_semi").select(
        "report_id", F.lit("original_file").alias("suffix")
    )
    return artifacts.join(deleted, "report_id", "left_semi").join(
        shared, ["report_id", "suffix"], "left_anti"
    )
