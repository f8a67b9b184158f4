"""WARC archives in which equal payloads are stored once.

Headers (page id, URL, payload digest, length), never payloads, are shuffled by
digest: of equal payloads the record with the smallest page id is the response,
the others revisit it. The decisions are joined back to the pages by page id, so
that a payload with very many copies does not gather in one task. Every record
gets fresh headers (ids from page and digest, the time of this writing) and a gzip
member of its own; a file begins with a warcinfo record. Files roll over at
``file_bytes``; a task's rows are in a fixed order and a file appears whole under
a fixed name, so that a repeated task writes the same files again.

Defined results: a null payload is empty; payloads under ``min_bytes`` are all
responses; a page without id revisits the smallest id among equal payloads, and
is a response if none has an id; repeated rows that hold the smallest id are all
responses; control characters in URLs are percent-encoded; without pages the folder
is empty and reads as no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import BROADCAST_BYTES, broadcast_if_small, make_folder, new_path, python_batches, release, stored
from tessera.llm.token_store import put_file

FILE_BYTES = 16 << 20
#: Parts over which the copies of one payload are dealt when they meet its first page.
SALTS = 32
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """id, digest, to, to_url: the pages that revisit an earlier equal payload."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    heads = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    heads = heads.filter(F.col("bytes") >= min_bytes)
    first = heads.filter("id is not null").groupBy("digest").agg(F.min(F.struct("id", F.coalesce("url", F.lit("")).alias("url"))).alias("first"))
    more = heads.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    first = first.join(more, "digest", "left_semi")
    first = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    again = heads.join(first, ["digest", "salt"]).filter(F.col("id").isNull() | (F.col("id") > F.col("first.id")))
    return again.select("id", "digest", F.col("first.id").alias("to"), F.col("first.url").alias("to_url")).distinct()


def _clean(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page is None else page}:{digest}>"


def _member(head: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(6, wbits=31)
    return z.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def info_record(name: str, date: str) -> bytes:
    """The record that says what a file is."""
    block = b"software: tessera\r\nformat: WARC file version 1.1\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], block)


def record(page: int | None, url: str | None, digest: str, payload: bytes, to: int | None = None, to_url: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, as a gzip member. ``to`` set: it revisits that page."""
    digest = _b32(digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if to is not None else http + payload
    head = [f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(to, digest)}", f"WARC-Refers-To-Target-URI: {_clean(to_url)}", f"Refers-To-Page-ID: {to}"]
    return _member([*head, "Content-Type: application/http; msgtype=response"], block)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(record headers, HTTP headers, payload) of every page record of an archive, one gzip member each."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, pieces, step = zlib.decompressobj(wbits=31), [], 4096
        while at < len(view) and not z.eof:  # in growing steps: what lies behind a member is copied in part only
            pieces.append(z.decompress(view[at : at + step]))
            at += min(step, len(view) - at) - len(z.unused_data)
            step *= 2
        raw = b"".join(pieces) + z.flush()
        head, _, rest = raw.partition(b"\r\n\r\n")
        meta = _headers(head)
        if meta["WARC-Type"] == "warcinfo":
            continue
        http, _, payload = rest[: int(meta["Content-Length"])].partition(b"\r\n\r\n")
        yield meta, _headers(http), payload


def _write(folder: str, file_bytes: int, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> None:
            nonlocal part, size
            if held:
                name = f"{task:06d}-{part:05d}.warc.gz"
                put_file(folder, name, b"".join([info_record(name, date), *held]))
                part, size = part + 1, 0
                held.clear()

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "digest", "payload", "to", "to_url")]
            for i in range(batch.num_rows):
                held.append(record(*(c[i].as_py() for c in columns), date))
                size += len(held[-1])
                if size >= file_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["files"])

    return run


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, folder: str | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> str:
    """Write every page as a response or revisit record; returns the archives' folder."""
    spark = pages.sparkSession
    python_batches(spark)
    folder = make_folder(spark, folder or new_path(spark, "warc"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")  # one for the run, so that a repeated task writes equal files
    again = revisits = stored(resolve_revisits(pages, id_col, url_col, payload_col, min_bytes), "revisits")
    again = broadcast_if_small(again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "to", "to_url"), F.length("to_url") * 4 + 128, broadcast_bytes)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("id", "url", "digest", "payload", "to", "to_url")
    rows = rows.sortWithinPartitions("id", "digest", "url")
    rows.mapInArrow(_write(folder, file_bytes, date), "files long").agg(F.sum("files")).collect()
    release(revisits)
    return folder


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page", "url", "digest", "type", "to", "bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for meta, http, payload in read_records(data.as_py()):
                page, to = meta.get("Page-ID"), meta.get("Refers-To-Page-ID")
                rows.append((int(page) if page else None, meta["WARC-Target-URI"], meta["WARC-Payload-Digest"].removeprefix("sha1:"), meta["WARC-Type"], int(to) if to else None, int(http["Content-Length"]), payload if meta["WARC-Type"] == "response" else None))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page, url, digest, type, to, bytes, payload (null in revisits) of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(_read, "page long, url string, digest string, type string, to long, bytes long, payload binary")


def archive_digest(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """Per record of the archives: id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured from the payload that was stored, revisits from their headers.
    """
    rows = read_archives(spark, folder)
    measured = F.coalesce(F.octet_length("payload").cast("long"), F.col("bytes"))
    return rows.select(F.col("page").alias(id_col), measured.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").alias("refers_to"))
