"""WARC archives: one gzip member per record, repeated payloads stored as revisits, read back in sequence.

An archive is written by Spark's text sink, so task retries and lost executors
leave no half files. The sink ends each line with a fixed character; a gzip
member ends with the high byte of its length, which is zero below 16 MiB. That
zero is the line end. (A longer record is followed by an empty member, which
ends with zero again.) The files hold nothing but gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.exprs import c

#: bytes of members that are written as one line, and lines of an archive: an archive has about 32 MB
BUNDLE_BYTES = 4 << 20
ARCHIVE_BUNDLES = 8
#: rows copied out of an Arrow batch at a time
ROWS_OUT = 16
#: compressed bytes read, and plain bytes produced, at a time
STEP = 1 << 16
#: a longer header block is taken for damage
HEADER_LIMIT = 1 << 20
#: Fixed values of the format
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
BLANK = b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDS = uuid.UUID(int=0x5EED)
#: what a header value may hold as it is
PLAIN = "".join(chr(x) for x in range(33, 127) if chr(x) != "%")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, 'page' if page is None else 'page ' + page)}>"


def head(fields: list[tuple[str, str | None]], first: bytes) -> bytes:
    return first + b"".join(f"\r\n{k}: {v}".encode() for k, v in fields if v is not None) + BLANK


def record(kind: str, page: str | None, url: str | None, payload: bytes, first_page: str | None, date: str) -> bytes:
    """One record; a revisit keeps the digest and the HTTP head of its payload but not the payload."""
    http = head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], b"HTTP/1.1 200 OK")
    block = http if kind == "revisit" else http + payload
    revisit = kind == "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, PLAIN)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + digest_text(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", "sha1:" + digest_text(hashlib.sha1(block).digest())),
        ("WARC-Profile", SAME_PAYLOAD if revisit else None),
        ("WARC-Refers-To", record_id(first_page) if revisit else None),
        ("Page-ID", None if page is None else quote(page, PLAIN)),
        ("Refers-To-Page-ID", None if first_page is None else quote(first_page, PLAIN)),
        ("Content-Length", str(len(block))),
    ]
    return head(fields, VERSION) + block + BLANK


def opening(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return head(fields, VERSION) + block + BLANK


def member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member that ends with a zero byte, with an empty member after it where its own last byte is not zero."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    made = z.compress(plain) + z.flush()
    return made if made[-1] == 0 else made + member(b"")


def archiving(date: str, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, parts, size = 0, [], 0
        for batch in batches:
            # a batch holds up to 64 MB of payloads; only a few rows at a time are copied out of it
            for row in (r for i in range(0, batch.num_rows, ROWS_OUT) for r in batch.slice(i, ROWS_OUT).to_pylist()):
                if not parts and lines % ARCHIVE_BUNDLES == 0:
                    parts.append(member(opening(date)))
                kind = "response" if row["first"] is None else "revisit"
                parts.append(member(record(kind, row["page"], row["url"], row["payload"], row["first"], date)))
                size += len(parts[-1])
                if size >= bundle_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["members"])
                    lines, parts, size = lines + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["members"])

    return run


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z", bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Writes a record per row into archives of about eight bundles below ``path``.

    Of rows with equal payloads the one with the least id is stored as response,
    the others as revisits of it. Rows that repeat the least id are responses
    too. A null id is never the least one; where all are null all are responses.
    A null payload is empty; a null url has no field. Urls and ids keep visible
    ASCII, the rest goes in as %XX. Payloads of any length are stored whole; an
    empty table gives archives without records. Other columns stay behind.

    Payloads are compared by SHA-256. The least ids are found with a combine
    before the shuffle; the join on a payload that many rows share is split by
    adaptive execution.
    """
    url = F.lit(None).cast("string") if url_col is None else c(url_col).cast("string")
    payload = F.coalesce(c(payload_col).cast("string"), F.lit("")).cast("binary")
    d = pages.select(c(id_col).alias("id"), url.alias("url"), payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    least = d.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1 and least is not null")
    again = F.when(~F.col("id").eqNullSafe(F.col("least")), F.col("least").cast("string"))
    rows = d.join(least.select("key", "least"), "key", "left").select(
        F.col("id").cast("string").alias("page"), "url", "payload", F.when(F.col("least").isNotNull(), again).alias("first")
    )
    lines = rows.mapInArrow(archiving(date, bundle_bytes), "members binary").select(F.col("members").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", ARCHIVE_BUNDLES).text(path)


@dataclass
class Framer:
    """Cuts the plain bytes of members into records by their Content-Length, checking digests on the way."""

    keep: bool
    buffer: bytearray = field(default_factory=bytearray)
    state: str = "head"
    done: list[dict] = field(default_factory=list)

    def feed(self, plain: bytes) -> None:
        self.buffer += plain
        while self.buffer and self.step():
            pass

    def step(self) -> bool:
        """Takes what it can off the buffer; false if it must wait for more."""
        if self.state in ("head", "http"):
            at = self.buffer.find(BLANK)
            if at < 0:
                if self.state == "http" and len(self.buffer) >= self.left:
                    self.start_payload(0)
                    return True
                if len(self.buffer) > HEADER_LIMIT:
                    raise ValueError("a header without an end")
                return False
            if self.state == "head":
                self.start_block(bytes(self.buffer[:at]))
                del self.buffer[: at + 4]
            elif at + 4 > self.left:
                self.start_payload(0)
            else:
                self.start_payload(at + 4)
            return True
        if self.state == "payload":
            part = bytes(self.buffer[: self.left])
            del self.buffer[: len(part)]
            self.take(part)
            if self.left == 0:
                self.state = "tail"
            return True
        if len(self.buffer) < 4:
            return False
        if self.buffer[:4] != BLANK:
            raise ValueError("the block is longer than its Content-Length")
        del self.buffer[:4]
        self.finish()
        return True

    def start_block(self, lines: bytes) -> None:
        first, *rest = lines.split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("no version line")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in rest)}
        length = self.fields.get("content-length", "")
        if not length.isdigit():
            raise ValueError("no Content-Length")
        self.left = int(length)
        self.http = b""
        self.block, self.sha, self.size, self.parts = hashlib.sha1(), hashlib.sha1(), 0, []
        if self.fields.get("content-type", "").startswith("application/http"):
            self.state = "http"
        else:
            self.state = "payload" if self.left else "tail"

    def start_payload(self, head_bytes: int) -> None:
        self.http = bytes(self.buffer[:head_bytes])
        self.block.update(self.http)
        self.left -= head_bytes
        del self.buffer[:head_bytes]
        self.state = "payload" if self.left else "tail"

    def take(self, part: bytes) -> None:
        self.left -= len(part)
        self.block.update(part)
        self.sha.update(part)
        self.size += len(part)
        if self.keep:
            self.parts.append(part)

    def finish(self) -> None:
        f, problem = self.fields, None
        kind = f.get("warc-type")
        size, digest = self.size, digest_text(self.sha.digest())
        told = f.get("warc-payload-digest", "").removeprefix("sha1:")
        if f.get("warc-block-digest", "sha1:").removeprefix("sha1:") not in ("", digest_text(self.block.digest())):
            problem = "block digest"
        elif kind == "revisit":
            length = next((x.partition(b":")[2] for x in self.http.lower().split(b"\r\n") if x.startswith(b"content-length:")), b"").strip()
            size, digest = (int(length) if length.isdigit() else None), told or None
        elif told not in ("", digest):
            problem = "payload digest"
        text = lambda name: None if name not in f else unquote(f[name])
        self.done.append(
            {"record_type": kind, "record_id": f.get("warc-record-id"), "page": text("page-id"), "url": f.get("warc-target-uri"), "payload_bytes": size,
             "payload_digest": digest, "refers_to": text("refers-to-page-id"), "payload": b"".join(self.parts) if self.keep and kind != "revisit" else None, "problem": problem}
        )
        self.state = "head"


def damaged(problem: str) -> dict:
    return {x: None for x in ("record_type", "record_id", "page", "url", "payload_bytes", "payload_digest", "refers_to", "payload")} | {"problem": problem}


def next_member(data: memoryview, at: int) -> int:
    """Start of the next member whose plain bytes begin a record; the end of the archive if there is none."""
    whole = bytes(data[at:])
    found = whole.find(MAGIC)
    while found >= 0:
        try:
            if zlib.decompressobj(31).decompress(whole[found : found + 4096], 5) == b"WARC/":
                return at + found
        except zlib.error:
            pass
        found = whole.find(MAGIC, found + 1)
    return len(data)


def read_records(archive: bytes, keep: bool = True) -> Iterator[dict]:
    """The records of an archive in order, with ``offset``, the first byte of their member.

    Members are decompressed ``STEP`` bytes at a time. After a damaged one (a row
    with a ``problem`` and no type) reading goes on at the next sound record.
    """
    data, at = memoryview(archive), 0
    while at < len(data):
        framer, z, pos, problem = Framer(keep), zlib.decompressobj(31), at, None
        try:
            while not z.eof:
                more = z.unconsumed_tail
                if not more:
                    more, pos = data[pos : pos + STEP], pos + STEP
                    if not more:
                        raise ValueError("the archive ends within a member")
                framer.feed(z.decompress(more, STEP))
            if framer.buffer or framer.state != "head":
                raise ValueError("the member ends within a record")
        except (zlib.error, ValueError) as e:
            problem = str(e)
        yield from ({**r, "offset": at} for r in framer.done)
        if problem is None:
            at = min(pos, len(data)) - len(z.unused_data)
        else:
            yield {**damaged(problem), "offset": at}
            at = next_member(data, at + 1)


FIELDS = {
    "archive": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "page": pa.string(), "url": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "problem": pa.string(),
}


def reading(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))

        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch["path"][i].as_py(), [], 0
                for r in read_records(batch["content"][i].as_buffer(), keep):
                    rows.append({**r, "archive": name})
                    size += 500 + len(r["payload"] or b"")
                    if size > BUNDLE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, damaged members included.

    (archive, offset, record_type, record_id, page_id, url, payload_bytes,
    payload_digest, refers_to, payload, problem). For a revisit bytes and digest
    are those of the payload it stands for, and ``payload`` is null.
    ``payloads=False`` leaves that column null. ``problem`` is null where
    framing and digests hold. An archive is read by one task, several archives
    by several; Spark holds at most one whole archive a task (2 GB at most).
    """
    kinds = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for n, t in FIELDS.items())
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(reading(payloads), kinds)
    ids = {"page": "page_id", "refers_to": "refers_to"}
    return found.select(*[F.col(x).cast(id_type).alias(ids[x]) if x in ids else F.col(x) for x in FIELDS])


def archive_digests(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of every page, as read back from archives written to ``path``."""
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path, pages.schema["page_id"].dataType.simpleString(), payloads=False)
    rows = found.where("record_type is null or record_type in ('response', 'revisit')")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("problem").isNull().alias("verified"))
