"""Operator 2: content-addressed WARC archive.

A record is an exact header block and a payload. Payload bytes are stored once
per SHA-256 digest; headers are stored apart, byte for byte, with the digest of
their payload. Reading joins both by digest, verifies every stored payload
against its address and puts the original record together again:
header block, empty line, payload, two line ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.common import Scratch, arrow_map

#: Payloads below this size are written as responses again, never as revisits.
REVISIT_BYTES = 100
EOL = "\r\n"
#: Fixed value: the profile of revisits that have an identical payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


@dataclass(frozen=True)
class Archive:
    """``headers`` (page_id, digest, header) and ``payloads`` (digest, first_id,
    packed: the payload as one zstd frame)."""

    headers: DataFrame
    payloads: DataFrame


#: Date of the records of a run, unless given; and the head of their blocks.
WRITTEN = "2000-01-01T00:00:00Z"
HTTP_HEAD = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    scratch: Scratch, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES, written: str = WRITTEN,
) -> Archive:
    """One record per row. Of equal payloads of at least ``revisit_bytes``, the
    rows with the smallest id are responses, the others revisit it. A record's block
    is an HTTP response around the payload; ``written`` is its date.

    Null body: empty payload; null url: no target field; null id: record id
    ``none``, never the smallest unless all are null (then all are responses).
    Rows that repeat the smallest id are responses each."""
    payloads = scratch.write(
        _packed_payloads(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(body_col).cast("string").alias("body")))
        .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.first("packed").alias("packed")))
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"))
    typed = rows.join(payloads.select("digest", "first_id"), "digest").withColumn(
        "revisit", (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))

    # a line break in a url would end the field
    url = F.regexp_replace("url", r"[\r\n]+", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"), field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"))), field("WARC-Date", F.lit(written)),
        F.when(F.col("url").isNotNull(), field("WARC-Target-URI", url)).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("revisit"), F.concat(
            field("WARC-Refers-To", _record_id(F.col("first_id"))), field("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", (F.col("bytes") + F.lit(len(HTTP_HEAD) + len(EOL))).cast("string")), F.lit(EOL + HTTP_HEAD))
    headers = scratch.write(typed.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")))
    return Archive(headers, payloads)


def _packed_payloads(bodies: DataFrame) -> DataFrame:
    """(page_id, body) -> (page_id, digest, packed): the zstd frame of the bytes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        raw = [cell.as_buffer() if cell.is_valid else b"" for cell in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([pack(x) for x in raw], pa.binary())],
            names=["page_id", "digest", "packed"])

    return arrow_map(bodies, run, "page_id bigint, digest string, packed binary")


def read_records(archive: Archive) -> DataFrame:
    """(page_id, record): the original WARC records, byte for byte. Every payload
    is checked against its address; a difference is an error."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for digest, header, packed in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            payload = unpack(packed)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload does not match digest {digest}")
            out.append(header + b"\r\n" + payload + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["page_id", "record"])

    joined = archive.headers.join(archive.payloads.select("digest", "packed"), "digest")
    return arrow_map(joined.select("page_id", "digest", "header", "packed"), run, "page_id bigint, record binary")


def parse_record(record: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(fields, payload) of one record; the block is taken by Content-Length, the
    payload is what stands behind the block's HTTP head."""
    end = record.index(b"\r\n\r\n") + 2
    if not record.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC record")
    fields = {m[1].lower(): m[2] for m in _FIELD.finditer(record, record.index(b"\r\n") + 2, end)}
    size = int(fields[b"content-length"])
    block = record[end + 2:end + 2 + size]
    if len(block) != size or record[end + 2 + size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not (head.startswith(b"HTTP/") and blank):
        raise ValueError("the block is no HTTP response")
    return fields, payload


def describe_records(records: DataFrame) -> DataFrame:
    """What the records say: (page_id, payload_bytes, payload_digest, record_type,
    refers_to), parsed from their bytes; the digest is of the payload read."""

    def number(uri: bytes | None) -> int | None:
        tail = uri[len(b"<urn:page:"):-1] if uri else b"none"
        return None if tail == b"none" else int(tail)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests, types, refers = [], [], [], [], []
        for cell in batch.column(0):
            fields, payload = parse_record(cell.as_py())
            ids.append(number(fields[b"warc-record-id"]))
            sizes.append(len(payload))
            digests.append(hashlib.sha256(payload).hexdigest())
            types.append(fields[b"warc-type"].decode())
            refers.append(number(fields.get(b"warc-refers-to")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
             pa.array(types, pa.string()), pa.array(refers, pa.int64())],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return arrow_map(records.select("record"), run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def export_warc(records: DataFrame, path: str) -> None:
    """Write the records as plain .warc text: Spark's text sink ends each row with
    one line feed, which is the record's own last byte."""
    cut = F.expr("substring(record, 1, octet_length(record) - 1)")
    records.select(cut.cast("string").alias("value")).write.option("lineSep", "\n").text(path)
