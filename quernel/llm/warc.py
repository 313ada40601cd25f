"""A content-addressed WARC archive.

Payload bytes are stored once, compressed, under their SHA-256. Exact record headers are kept separately, one row a
record. A record as it would stand in a .warc file is rebuilt by a join of its header with its payload. Payloads of one
digest are held to be equal if their lengths and XXH64 agree too, or writing fails; when records are rebuilt, the digest
and the length in the header are computed anew from the stored bytes, or reading fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.plans.storage import materialize, new_path

LEAST_SHARED = 100  # bytes from which equal payloads are stored as revisits
DATE = "2024-01-01T00:00:00Z"
HELD = 8 << 20  # bytes of records that a worker hands over at once


def record_uri(page: Column, row: Column) -> Column:
    """Ids of records: rows may repeat a page_id or have none."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"))


def _header(kind: Column, page: Column, row: Column, url: Column, digest: Column, n_bytes: Column, refers: Column, refers_row: Column) -> Column:
    """Exact header bytes as text: WARC lines, an empty line, HTTP lines, an empty line."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.length(http) + F.when(kind == "response", n_bytes).otherwise(F.lit(0))
    # a line break in a url would end the header line
    target = F.regexp_replace(url, "[\\r\\n]", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), record_uri(page, row), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <"), record_uri(refers, refers_row), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n, h, payload) with the payload as one zstd frame."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            packed = pa.array([press.compress(p) for p in part.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], packed], names=["digest", "n", "h", "payload"])


def write_archive(pages: DataFrame, path: str, least_shared: int = LEAST_SHARED) -> None:
    """Write ``path``/payloads (digest, payload) and ``path``/headers (page_id, digest, revisit, header), one header a row of ``pages``.

    Null html is an empty payload. Of records with equal payloads of ``least_shared`` bytes or more, that with the
    smallest page_id is a response and the others revisit it; smaller ones are all responses. Of rows that repeat a
    page_id with the same payload one is the response. A null page_id never is what others revisit: such records are
    responses. Other columns are not read. Payloads cross the network once, compressed and one a digest and task;
    everything else about them is their digest and length.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    facts = rows.select("page_id", "url", "row", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("n_bytes"))
    facts = materialize(facts, "facts")
    # the one row of each digest whose record is the response
    lead = F.struct(F.col("page_id").isNull(), "page_id", "row")
    stored = facts.groupBy("digest").agg(F.min_by("page_id", lead).alias("first"), F.min_by("row", lead).alias("first_row"), F.count("*").alias("copies"))
    stored = materialize(stored, "stored")
    shared = (F.col("n_bytes") >= least_shared) & F.col("page_id").isNotNull() & (F.col("row") != F.col("first_row"))
    kinds = facts.join(stored.where("copies > 1"), "digest", "left").withColumn("kind", F.when(shared, "revisit").otherwise("response"))
    header = _header(F.col("kind"), F.col("page_id"), F.col("row"), F.col("url"), F.col("digest"), F.col("n_bytes"), F.col("first"), F.col("first_row"))
    headers = kinds.select("page_id", "digest", (F.col("kind") == "revisit").alias("revisit"), header.alias("header"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    packed = rows.select(F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n"), F.xxhash64("payload").alias("h"), "payload")
    packed = packed.mapInArrow(_pack, "digest string, n int, h long, payload binary")
    second = F.struct("n", "h")
    bodies = packed.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(second).alias("low"), F.max(second).alias("high"))
    verified = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")))
    bodies.select("digest", verified.alias("payload")).write.parquet(f"{path}/payloads")


_RECORD = "page_id long, record binary, payload binary"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, digest, revisit, header, packed) to whole records, payloads held against digest and length."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        done, size = [], 0
        for i in range(batch.num_rows):
            page, digest, revisit, header, packed = (c[i].as_py() for c in batch.columns)
            if packed is None:
                raise ValueError("a record's payload is not stored")
            payload = open_.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("a stored payload does not have its digest")
            record = header.encode() + (b"" if revisit else payload) + b"\r\n\r\n"
            done.append((page, record, payload))
            size += len(record) + len(payload)
            if size >= HELD or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.binary()))], names=["page_id", "record", "payload"])
                done, size = [], 0


def _whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads").withColumnRenamed("payload", "packed")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: page_id, record (the bytes as they would stand in a .warc file), payload (revisits have that of the record they refer to)."""
    headers, payloads = _whole(spark, path)
    joined = headers.join(payloads, "digest", "left").select("page_id", "digest", "revisit", "header", "packed")
    return joined.mapInArrow(_rebuild, _RECORD)


def parse_record(record: bytes) -> tuple[int, str, str, str | None]:
    """(payload bytes, payload digest, type, refers to) of a whole record; the length in its header must be that of its block."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:-4]
    if not rest.endswith(b"\r\n\r\n") or int(fields["Content-Length"]) != len(block):
        raise ValueError("a record does not have the length in its header")
    payload = block.split(b"\r\n\r\n", 1)[1]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        return len(payload), stated, "revisit", fields["WARC-Refers-To"]
    if hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError("a record's payload does not have its digest")
    return len(payload), stated, "response", None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilt responses to what their bytes tell."""
    for batch in _rebuild(batches):
        rows = [(p.as_py(), *parse_record(r.as_py())[:3]) for p, r in zip(batch.column(0), batch.column(1))]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type"])


def header_field(name: str) -> Column:
    """The value of a WARC header line, null without it."""
    warc = F.substring_index("header", "\r\n\r\n", 1)
    value = F.regexp_extract(warc, f"(?m)^{name}: ([^\\r]*)\\r?$", 1)
    return F.when(value != "", value)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from whole records: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every response is rebuilt by joining its header with its payload, and read again from its bytes. A revisit is its
    header alone; the bytes of its payload are those of the rebuilt response that has its digest.
    """
    headers, payloads = _whole(spark, path)
    joined = headers.where("not revisit").join(payloads, "digest", "left").select("page_id", "digest", "revisit", "header", "packed")
    responses = materialize(joined.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string"), "responses")
    refers = F.regexp_extract(F.coalesce(header_field("WARC-Refers-To"), F.lit("")), "<urn:page:(-?[0-9]+):[0-9]+>", 1)
    revisits = headers.where("revisit").select("page_id", F.substring_index(header_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), header_field("WARC-Type").alias("record_type"), refers.cast("long").alias("refers_to"))
    known = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.join(known, "payload_digest", "left")
    missing = F.raise_error(F.lit("a revisit's payload is not stored"))
    found = found.withColumn("payload_bytes", F.coalesce("payload_bytes", missing.cast("long")))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(found.select(*names))


def archive(pages: DataFrame) -> DataFrame:
    """Write an archive of ``pages`` into the shared folder and return its index as read back from whole records."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_index(pages.sparkSession, path)
