"""WARC archives: writing pages as zipped records, reading them back, assembling captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.spark_io import scratch, stored

#: Zipped records are written in rows of about so many bytes, and so many rows make an archive.
CHUNK_BYTES, CHUNKS_PER_ARCHIVE = 8 << 20, 8
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits become four letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str | Column, record_id: Column, headers: list[Column], block: Column) -> Column:
    """One record as bytes in a string, without the two line ends after it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Date: "), date, *headers)
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters and line ends can't break out of it."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]", "%20")), F.lit(""))


def _urn(part: str, key: Column) -> Column:
    """A record id made from the part and a key, written like a UUID."""
    h = F.sha2(F.concat(F.lit(f"{part}:"), key), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _key(page: Column, digest: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("")), digest)


def zipped(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``value`` of about ``chunk_bytes`` of gzip members, one for each record of all columns, a row after the other.

    The last byte of a row is left out: it is zero, and the writer's line separator puts it back. It is the top byte of
    the last record's size; after one of 16 MiB or more comes an empty member, whose size is zero.
    """
    empty = gzip.compress(b"", mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def row() -> pa.RecordBatch:
            if held[-1]:
                held.extend(empty)
            out = pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], ["value"])
            held.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                for column in batch.columns:
                    held.extend(gzip.compress(b"".join((column[k].as_buffer(), b"\r\n\r\n")), 6, mtime=0))
                if len(held) >= chunk_bytes:
                    yield row()
        if held:
            yield row()

    return records.mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes three records per row of ``pages`` (response or revisit, request, metadata), each a gzip member, as archives in ``path``.

    Of rows with the same payload of ``min_bytes`` or more the one with the smallest id is a response and the others
    revisit it; rows that share this smallest id are all responses. A revisit names the response's url and page, and
    its record where the page is one row. A null payload is empty, a null url or id leaves its header out. The request
    and the metadata point to the response or revisit through WARC-Concurrent-To; the metadata record carries the
    page's id. An archive holds ``CHUNKS_PER_ARCHIVE`` rows of ``chunk_bytes``, each by one capture longer at most.

    Equal payloads are found on ids and digests alone. The payloads move once, by id and digest, and not at all where
    what is told of the equal ones is small enough for Spark to broadcast.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    each = rows.groupBy("id", "digest", "bytes").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    first = each.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.min_by("n", "id").alias("first_n"), F.min_by("url", "id").alias("first_url"), F.sum("n").alias("all")).where("all > 1").drop("all")
    told = each.where("n > 1 OR bytes >= " + str(int(min_bytes))).join(first, ["digest", "bytes"], "left").where("n > 1 OR first IS NOT NULL").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "n", "first", "first_n", "first_url")
    told = stored(told, "equal")  # Spark knows its size before it plans the join
    rows = rows.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    own = _key(F.col("id"), F.col("digest"))
    rows = rows.withColumn("key", F.when(F.col("n") > 1, F.concat_ws(" ", own, F.monotonically_increasing_id().cast("string"))).otherwise(own)).withColumn("again", again)
    rows = rows.withColumn("main", F.when(F.col("again"), _urn("revisit", F.col("key"))).otherwise(_urn("response", F.col("key"))))
    refers = F.concat(
        F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"), F.when(F.col("first_n") == 1, F.concat(F.lit("\r\nWARC-Refers-To: "), _urn("response", _key(F.col("first"), F.col("digest"))))).otherwise(""),
        _header("WARC-Refers-To-Target-URI", F.col("first_url")), F.lit("\r\nWARC-Refers-To-Page: "), F.url_encode(F.col("first").cast("string")),
    )
    url = _header("WARC-Target-URI", F.col("url"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    head = F.concat(http, F.col("bytes").cast("string"), F.lit(_END))
    block = F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload").cast("string")))
    response = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), F.col("main"),
        [url, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
         F.when(F.col("again"), refers).otherwise("")],
        block,
    )
    near = [url, F.lit("\r\nWARC-Concurrent-To: "), F.col("main")]
    path_of = F.regexp_replace(F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    host_of = F.regexp_replace(F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    asked = F.concat(F.lit("GET "), F.when(path_of.startswith("/"), path_of).otherwise(F.concat(F.lit("/"), path_of)), F.lit(" HTTP/1.1\r\nHost: "), host_of, F.lit(_END))
    request = _record("request", _urn("request", F.col("key")), [*near, F.lit("\r\nContent-Type: application/http;msgtype=request")], asked)
    about = F.concat(F.lit("format: html"), _header("pageId", F.url_encode(F.col("id").cast("string"))), F.lit("\r\npayloadBytes: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", F.col("key")), [*near, F.lit("\r\nContent-Type: application/warc-fields")], about)
    records = rows.select(*[r.cast("binary").alias(n) for r, n in ((response, "response"), (request, "request"), (metadata, "metadata"))])
    lines = zipped(records, chunk_bytes).select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS_PER_ARCHIVE).text(path)


RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "type", "url", "concurrent_to", "refers_to_page", "date", "stated_digest", "payload_digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("block", T.BinaryType())]
)


class _Stream:
    """Bytes of one archive, unzipped as they are asked for."""

    def __init__(self, content: bytes, step: int = 1 << 16):
        self.content, self.at, self.step, self.held = memoryview(content), 0, step, bytearray()
        self.unzip = zlib.decompressobj(31) if bytes(self.content[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at : self.at + self.step]
        self.at += len(part)
        while part:
            self.held += self.unzip.decompress(part) if self.unzip else part
            part = b""
            if self.unzip and self.unzip.eof:  # the next member of the file
                part, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
        return True

    def until(self, end: bytes) -> bytes | None:
        start = 0
        while (found := self.held.find(end, start)) < 0:
            start = max(0, len(self.held) - len(end))
            if not self.more():
                return None
        return self.take(found + len(end))[:found]

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(content: bytes, with_block: bool = True) -> Iterator[dict]:
    """The records of one archive, gzip or plain, by their stated lengths: payloads may hold anything."""
    stream = _Stream(content)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not (head := head.strip(b"\r\n")):  # the two line ends after a record
            continue
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts here: {lines[0][:60]!r}")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(h["content-length"]))
        out = {"record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "url": h.get("warc-target-uri"), "concurrent_to": h.get("warc-concurrent-to"), "refers_to_page": h.get("warc-refers-to-page"), "date": h.get("warc-date"), "stated_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        out |= {"payload_digest": None, "payload_bytes": None}
        if out["type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :] if h.get("content-type", "").startswith("application/http") else block
            out |= {"payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload_bytes": len(payload)}
        yield out | {"block": block if with_block or out["type"] == "metadata" else None}


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``. Payload digests are computed from what is read, not copied.

    ``with_block`` False leaves out the blocks of responses, revisits and requests, which then never leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in parse(content.as_buffer(), with_block):
                    rows.append(record)
                    size += len(record["block"] or b"") + 500
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kinds.get(f.name, pa.string())) for f in RECORD.fields], [f.name for f in RECORD.fields])


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, each a struct of the record or null.

    Requests and metadata meet the response or revisit that their concurrent-to identifier names. Of several records
    of one kind the one with the least record id is taken; a request or metadata record that names no record stays
    alone under the name it gives.
    """
    main = F.col("type").isin("response", "revisit")
    row = F.struct(*[F.col(f.name) for f in RECORD.fields])
    one = lambda which: F.min_by(F.when(which, row), F.when(which, F.col("record_id")))
    keyed = records.where(main | F.col("concurrent_to").isNotNull())
    return keyed.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(
        one(main).alias("response"), one(F.col("type") == "request").alias("request"), one(F.col("type") == "metadata").alias("metadata")
    )


def _field(block: Column, name: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(block.cast("string"), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit("")))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, path: str | None = None, with_block: bool = False) -> DataFrame:
    """Writes ``pages`` to archives, reads these back and assembles the captures, with the page's id and whole payload.

    Rows (id_col, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok, capture), one per row of
    ``pages``. payload_bytes and payload_digest of a revisit are those of the full payload, from its metadata and
    header. ``digest_ok`` tells whether the digest computed from the bytes read equals the stated one. Repeated rows
    are captures of their own. An empty table gives no rows; a null id gives a capture with a null id, which is no
    response to others unless all their ids are null; other columns are ignored; ids of any characters come back as they were.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes)
    found = assemble(read_archives(spark, path, with_block))
    kind = pages.schema[id_col].dataType
    flat = found.select(
        _field(F.col("metadata.block"), "pageId").cast(kind).alias(id_col), F.col("response.url").alias("url"), F.col("response.type").alias("record_type"),
        F.url_decode("response.refers_to_page").cast(kind).alias("refers_to"), F.col("response.stated_digest").alias("payload_digest"),
        F.coalesce(F.col("response.payload_bytes"), _field(F.col("metadata.block"), "payloadBytes").cast("long")).alias("payload_bytes"),
        F.coalesce(F.col("response.payload_digest"), F.col("response.stated_digest")).eqNullSafe(F.col("response.stated_digest")).alias("digest_ok"),
        F.struct("capture_id", "response", "request", "metadata").alias("capture"),
    )
    return flat
