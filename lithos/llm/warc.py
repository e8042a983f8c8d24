"""WARC archives: one gzip member for each record, read in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parquet, scratch, tidy
from .tokenfiles import filesystem

#: An archive is closed when it has so many compressed bytes.
ROLL_BYTES = 128 << 20
READ_BYTES = 1 << 16
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    head += f"WARC-Block-Digest: sha1:{base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


class DamagedArchive(ValueError):
    pass


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream in sequence, each inflated as its bytes arrive."""
    unpack, out, held, begun = zlib.decompressobj(31), [], b"", False
    while chunk := held or stream.read(READ_BYTES):
        out.append(unpack.decompress(chunk))
        held, begun = b"", True
        if unpack.eof:
            yield b"".join(out)
            held, unpack, out, begun = unpack.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise DamagedArchive("the last member is cut off")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; framing and block digests are verified."""
    for data in members(stream):
        head, gap, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not gap or not first.startswith(b"WARC/1."):
            raise DamagedArchive(f"no WARC header but {first[:40]!r}")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        length = int(headers["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise DamagedArchive(f"{headers.get('warc-record-id')}: {len(rest)} bytes after the header, Content-Length is {length}")
        block = rest[:length]
        verify(headers, "warc-block-digest", block)
        yield headers, block


def verify(headers: dict[str, str], name: str, data: bytes) -> None:
    if name in headers and headers[name].upper() != f"SHA1:{base32_sha1(data)}":
        raise DamagedArchive(f"{headers.get('warc-record-id')}: {name} is {headers[name]}, the data's is {base32_sha1(data)}")


def _page(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits.lstrip("-").isdigit() else None


ARCHIVES = "path string, n_records long, n_bytes long"
_FILES = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload and refers_to: the largest page_id of equal payloads of `least` bytes or more.

    refers_to is null for that page and for payloads without equals. Rows that repeat the largest
    page_id are all responses. Equal means equal in SHA-256 and length. Spark splits hot digests in the join.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = pages.withColumns({"__sha": F.unhex(F.sha2("payload", 256)), "__len": F.octet_length("payload")})
    groups = keyed.filter(F.col("__len") >= least).groupBy("__sha", "__len").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    joined = keyed.join(groups, ["__sha", "__len"], "left")
    other = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("__first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes marked pages (from mark_revisits) to archives in folder; returns (path, n_records, n_bytes).

    Each task writes files of its own attempt's name and the returned table lists those that ended well,
    so that retried tasks leave no doubles. A null url gives no target URI; a null page_id an unnumbered record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _record(row)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = done.append({"path": f"{folder}/{name}", "n_records": count, "n_bytes": size})
        if out is not None:
            out.close()
            done.append({"path": f"{folder}/{name}", "n_records": count, "n_bytes": size})
        yield pa.RecordBatch.from_pylist(done, _FILES)

    return materialize(marked.mapInArrow(tidy(run), ARCHIVES), "archives")


def _record(row: dict) -> bytes:
    payload, revisit = row["payload"], row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda page: f"<urn:x-page:{'unnumbered' if page is None else page}>"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"]))]
    return record(headers, http if revisit else http + payload)


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of archives (path): a row for each, read in sequence, a task for each few files.

    payload_bytes is the HTTP Content-Length, which revisits carry as well; a response's payload is held
    against it and against the payload digest. payload is null for revisits. Rows that repeat a page_id are
    records of their own; no archives (an empty table) give no rows. Damage raises DamagedArchive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for headers, block in records(stream):
                        if headers["warc-type"] not in ("response", "revisit"):
                            continue
                        held.append(_read(headers, block, with_payload))
                        size += len(held[-1]["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, _PAGES)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _PAGES)

    n = archives.count()
    return archives.select("path").repartition(max(1, min(n, 10_000)), "path").mapInArrow(tidy(run), PAGES)


def _read(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length")
    revisit = headers["warc-type"] == "revisit"
    if not revisit:
        verify(headers, "warc-payload-digest", payload)
        if len(payload) != length:
            raise DamagedArchive(f"{headers.get('warc-record-id')}: payload of {len(payload)} bytes, HTTP says {length}")
    return {
        "page_id": _page(headers["warc-record-id"]), "payload_bytes": length, "payload_digest": headers["warc-payload-digest"].partition(":")[2], "record_type": headers["warc-type"],
        "refers_to": _page(headers.get("warc-refers-to")) if revisit else None, "url": headers.get("warc-target-uri"), "payload": payload if with_payload and not revisit else None,
    }


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(mark_revisits(parquet(spark, sf_dir, "pages")), scratch(spark, "warc"))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc_roundtrip": op1_warc_roundtrip}

ORACLE_SQL = {
    "op1_warc_roundtrip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h,
  max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
}
