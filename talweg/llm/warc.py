"""WARC archives: writing with segmentation and chunked framing, and reassembly.

Long record blocks are cut into a first record and ``continuation`` records.
Reading groups continuations by their origin's identifier, orders them by segment
number, verifies the total length and undoes HTTP chunked transfer framing.

Defined cases: a null payload is empty; a null id or url leaves its header out; rows
repeated with the same id stay apart; a record of which a segment is missing, is
repeated, or whose length differs from the total has status ``incomplete`` and null
payload; broken chunk framing has status ``bad_framing``; a payload whose SHA-1 differs from the
declared one keeps its bytes and both digests, and has status ``bad_digest``.  Equal rows of the largest
id of a group are all responses.  Archives may be compressed (``.gz``) or not.  Empty tables write no
archive and read back as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
ARCHIVE_BYTES = 128 << 20
SALTS = 16
_URN = "urn:talweg:page:"
_DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, record_type string, origin_id string, segment int, total_length long, "
    "page_id long, refers_to long, target_uri string, payload_digest string, block binary"
)
RECORD_ARROW = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()),
     ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("block", pa.binary())]
)
PAYLOAD_SCHEMA = (
    "record_id string, page_id long, target_uri string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, declared_digest string, payload binary, status string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mark_revisits(df: DataFrame, page_id: str = "page_id", payload: str = "payload", min_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to: of equal payloads the largest id is the response.

    Payloads shorter than ``min_bytes`` are all responses.  Groups of copies are
    counted with partial sums, and their rows dealt over salts, so a group with a
    third of all rows does not meet in one task.
    """
    df = df.withColumns({"__sha": F.sha1(payload), "__len": F.length(payload), "__salt": F.pmod(F.xxhash64(page_id), F.lit(SALTS)).cast("int")})
    groups = df.groupBy("__sha", "__len").agg(F.count("*").alias("__n"), F.max(page_id).alias("__keep"))
    groups = groups.filter((F.col("__n") > 1) & (F.col("__len") >= min_bytes)).drop("__n")
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    df = df.join(groups, ["__sha", "__len", "__salt"], "left")
    again = F.coalesce(F.col(page_id) < F.col("__keep"), F.lit(False))
    return df.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("__keep"))}).drop("__sha", "__len", "__salt", "__keep")


def _uri(text: str) -> str:
    """No white space or control characters, which would end the header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)  # trailers are dropped
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, unique: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of one page, cut into segments of at most ``segment_bytes``."""
    rid = f"<{_URN}{page_id}/{unique}>"
    head: list[tuple[str, object]] = [
        ("WARC-Type", record_type), ("WARC-Record-ID", rid), ("WARC-Date", _DATE), ("WARC-Target-URI", url and _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response"),
    ]
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
        yield _record(head, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(head, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, i in enumerate(cuts, 1):
        own = [*head, ("WARC-Segment-Number", 1)] if k == 1 else [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{_URN}{page_id}/{unique}/{k}>"), ("WARC-Date", _DATE),
            ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(cuts) else None),
        ]
        yield _record(own, block[i : i + segment_bytes])


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:/", uri) else f"file://{uri}")


def write_archives(df: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, record_type, refers_to) rows as .warc.gz files.

    Returns the manifest (path, records, bytes) of what succeeded, kept by a
    checkpoint.  Each attempt of a task writes files of its own, so files of failed or
    speculative attempts are never listed.  ``folder`` is any URI that Arrow can open.
    """
    rows = df.select("page_id", "url", "payload", "record_type", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        part, n_rows, out, path, done, records = TaskContext.get().partitionId(), 0, None, "", 0, 0
        made: list[tuple[str, int, int]] = []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    path, done, records = posixpath.join(base, f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"), 0, 0
                    out = fs.open_output_stream(path, compression=None)
                for rec in page_records(row["page_id"], row["url"], row["payload"] or b"", row["record_type"], row["refers_to"], f"{part}-{n_rows}", segment_bytes):
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    done += out.write(z.compress(rec) + z.flush())
                    records += 1
                n_rows += 1
                if done >= archive_bytes:
                    out.close()
                    made.append((path, records, done))
                    out = None
        if out is not None:
            out.close()
            made.append((path, records, done))
        names = [posixpath.join(folder, posixpath.basename(p)) for p, _, _ in made]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(write, "path string, records long, bytes long"))


def parse_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def _sha1_of(declared: str) -> str | None:
    """The base32 digest of a ``sha1:`` declaration; other algorithms are not verified."""
    label, _, digest = declared.partition(":")
    return digest.strip().upper() or None if label.strip().lower() == "sha1" else None


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the archives named in column ``path``; one task reads a file as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = _filesystem(path)
                with fs.open_input_stream(p, compression=None, buffer_size=1 << 20) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if p.endswith(".gz") else io.BufferedReader(raw)
                    for h, block in parse_records(stream):
                        kind, ref = h.get("warc-type"), h.get("warc-refers-to", "")
                        first = h.get("warc-record-id")
                        rows.append({
                            "record_id": first, "record_type": kind, "origin_id": h.get("warc-segment-origin-id", first), "segment": _number(h.get("warc-segment-number")),
                            "total_length": _number(h.get("warc-segment-total-length")), "page_id": _number(h.get("x-page-id")), "target_uri": h.get("warc-target-uri"),
                            "refers_to": _number(ref[len(_URN) + 1 : -1]) if ref.startswith(f"<{_URN}") else None,
                            "payload_digest": _sha1_of(h.get("warc-payload-digest", "")), "block": block,
                        })
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    # one task a file: a count of partitions, which adaptive execution does not merge
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORD_SCHEMA)


def _decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in PAYLOAD_SCHEMA.split(",")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    for b in rows:
        out = []
        for r in b.to_pylist():
            block, status, payload = b"".join(r["blocks"]), "ok", None
            n = digest = None
            if r["numbers"] is not None and (r["numbers"] != list(range(1, len(r["numbers"]) + 1)) or r["total"] != len(block)):
                status = "incomplete"
            if status == "ok":
                head, _, body = block.partition(b"\r\n\r\n")
                if r["record_type"] == "revisit":
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    n, digest = m and int(m[1]), r["payload_digest"]
                else:
                    payload = dechunk(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body
                    if payload is None:
                        status = "bad_framing"
                    else:
                        n, digest = len(payload), base32_sha1(payload)
                        if r["payload_digest"] not in (None, digest):
                            status = "bad_digest"
            out.append((r["record_id"], r["page_id"], r["target_uri"], r["record_type"], r["refers_to"], n, digest, r["payload_digest"], payload, status))
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def reassemble(records: DataFrame) -> DataFrame:
    """Payloads of whole and segmented records.

    Only segments are shuffled, by their origin's identifier; a group is the
    segments of one record, so its size is that of one payload.
    """
    keep = ["record_id", "record_type", "page_id", "refers_to", "target_uri", "payload_digest"]
    whole = records.filter(F.col("segment").isNull()).select(*keep, F.array("block").alias("blocks"), F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("long").alias("total"))
    segs = records.filter(F.col("segment").isNotNull()).groupBy("origin_id").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("segs"), F.max("total_length").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in keep],
    )
    segs = segs.select(*keep, F.col("segs.block").alias("blocks"), F.col("segs.segment").alias("numbers"), "total")
    return whole.unionByName(segs).mapInArrow(_decode, PAYLOAD_SCHEMA)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every response, revisit and other record with a payload, continuations joined."""
    return reassemble(read_records(manifest))
