"""WARC archives with revisit records.

Headers (identifier, payload digest, length) are shuffled by digest to choose
the original of each payload; every other capture becomes a revisit record
that refers to it. Archives are written by Spark's own committer, read back as
files, and the revisits joined to their originals by digest.

File format: each record is a gzip member of its own, as in ``.warc.gz``. The
text writer ends each row with a separator; the rows here are made to end in
an empty gzip member short of its last byte, a zero, and the separator is that
byte. The files are whole gzip files of bounded size, readable by any tool.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import as_bytes
from evalspark.session import scratch_path

FILE_BYTES = 8 << 20  # compressed; a file ends with the record that passes it
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # uuid5 namespace for URLs
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time; a fixed one keeps reruns equal
_PAD = zlib.compressobj(9, zlib.DEFLATED, 31).flush()  # an empty member; it ends in zeros


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def make_record(page_id, url: str | None, payload: bytes, original) -> bytes:
    """One record. ``original``: the identifier of the capture this one
    revisits, or None for a response."""
    digest = digest_of(payload)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if original is not None else http + payload
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if original is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_DATE}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if original is not None:
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}"]
    if page_id is not None:
        lines.append(f"X-Capture-ID: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0

        def file_row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([b"".join([*parts, _PAD[:-1]])], pa.binary())], names=["value"])

        for batch in batches:
            ids, originals = batch.column("page_id").to_pylist(), batch.column("original").to_pylist()
            urls, revisit = batch.column("url").to_pylist(), batch.column("revisit").to_pylist()
            for i, payload in enumerate(batch.column("payload")):
                record = make_record(ids[i], urls[i], as_bytes(payload),
                                     originals[i] if revisit[i] else None)
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                parts.append(pack.compress(record) + pack.flush())
                held += len(parts[-1])
                if held >= file_bytes:
                    yield file_row()
                    parts, held = [], 0
        if parts:
            yield file_row()
    return run


def _records(data: memoryview) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    at = 0
    while at < len(data):
        d, out = zlib.decompressobj(31), []
        while not d.eof and at < len(data):
            step = data[at:at + 32768]
            out.append(d.decompress(step))
            at += len(step) - len(d.unused_data)
        if not d.eof:
            raise ValueError("archive ends inside a record")
        record = b"".join(out)
        if record:
            yield record


def parse_record(record: bytes) -> dict:
    """Headers of a record, its payload length, and the check of its digests."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(h["Content-Length"])]
    if not lines[0].startswith("WARC/") or f"sha1:{digest_of(block)}" != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h.get('WARC-Record-ID')}")
    payload = block.partition(b"\r\n\r\n")[2]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not have its digest")
    return {"capture": h.get("X-Capture-ID"), "record_type": h["WARC-Type"],
            "record_id": h["WARC-Record-ID"], "refers_to_record": h.get("WARC-Refers-To"),
            "url": h["WARC-Target-URI"], "payload_digest": digest,
            "payload_bytes": len(payload) if h["WARC-Type"] == "response" else None,
            "payload": payload if h["WARC-Type"] == "response" else None}


_FIELDS = [("capture", pa.string(), "string"), ("record_type", pa.string(), "string"),
           ("record_id", pa.string(), "string"), ("refers_to_record", pa.string(), "string"),
           ("url", pa.string(), "string"), ("payload_digest", pa.string(), "string"),
           ("payload_bytes", pa.int64(), "bigint"), ("payload", pa.binary(), "binary")]


def _parse(names: list[str]):
    fields = [f for f in _FIELDS if f[0] in names]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], k) for n, k, _ in fields], names=[f[0] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in _records(memoryview(content.as_buffer())):
                    row = parse_record(record)
                    rows.append({n: row[n] for n in names})
                    held += len(row["payload"] or b"") if "payload" in names else 100
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)
    return run, ", ".join(f"{n} {sql}" for n, _, sql in fields)


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of an archive folder; every digest is checked on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    run, schema = _parse([f[0] for f in _FIELDS if payloads or f[0] != "payload"])
    return files.select("content").mapInArrow(run, schema)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0,
                  file_bytes: int = FILE_BYTES) -> None:
    """Write a record per page: a response, or a revisit of the equal payload
    (of at least ``min_bytes``) with the largest identifier.

    Defined cases: a null payload is empty; pages that repeat both the chosen
    identifier and its payload are all responses; null identifiers stand below
    all others, and a payload that only they have is a response each time; an
    empty table writes no records. Payloads move once, by digest; a payload
    with very many captures is split by Spark's skew handling, and the other
    side has one short row per digest.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    originals = (rows.select("page_id", "sha", F.octet_length("payload").alias("n"))
                 .filter(F.col("n") >= min_bytes)
                 .groupBy("sha").agg(F.max("page_id").alias("original")))
    told = rows.join(originals, "sha", "left").select(
        "page_id", "url", "payload", "original",
        (F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")))
        .alias("revisit"))
    (told.mapInArrow(_members(file_bytes), "value binary")
     .select(F.col("value").cast("string"))
     .write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each record with its payload length and, for a revisit, the capture it
    refers to, by joining the revisits to the responses on the digest. A
    revisit whose response is in no archive keeps nulls there."""
    originals = (records.filter(F.col("record_type") == "response")
                 .groupBy("payload_digest", F.col("record_id").alias("refers_to_record"))
                 .agg(F.max("capture").alias("refers_to"),
                      F.max("payload_bytes").alias("original_bytes")))
    joined = records.join(originals, ["payload_digest", "refers_to_record"], "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes"))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0,
                  path: str | None = None) -> DataFrame:
    """Write the archives, read them back, resolve: one row per page with
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``refers_to``."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, id_col, url_col, payload_col, min_bytes)
    kind = pages.schema[id_col].dataType.simpleString()
    return resolve_revisits(read_archive(spark, path)).select(
        F.col("capture").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
