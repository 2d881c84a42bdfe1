"""WARC archives: writing with revisits and segments, and reassembly on reading.

Writing: every page is a record. A payload of at least REVISIT_BYTES that equals
an earlier page's (by SHA-256) becomes a revisit of it. A block above
``segment`` bytes is cut into a first record and continuation records. Bodies
have chunked transfer framing. Spark's text writer joins the records with the
blank lines that end them, so the files are committed like any other output.

Reading: the text reader cuts files at ``WARC/1.`` as it streams. A piece shorter
than its Content-Length means that the mark stands in a payload; files with such
pieces are read again from their bytes alone. Continuations are grouped by their
origin's id and ordered by segment number; numbers without a gap and the stated
total length are required. Then framing is removed and the digest compared.

Defined cases: a null payload is empty. Pages without an id form records with a
null page id. Repeated rows of the page with the smallest id are responses each.
A record that fails a check has ``complete`` false and a null payload. No pages
give an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintmill.llm.common import broadcast_if_small, written
from lintmill.session import checkpoint_dir

REVISIT_BYTES = 100
SEGMENT = 32 << 10
CHUNK = 8 << 10
MARK = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORDS = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("segment", pa.int32()),
    ("origin", pa.string()), ("total", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary()), ("whole", pa.bool_()),
])
RECORDS = (
    "file string, record_id string, type string, page_id long, uri string, segment int, origin string, total long, "
    "refers_to string, digest string, block binary, whole boolean"
)


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(map(str, parts)).encode()).digest()[:16])}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing; no chunk holds MARK as a whole."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        mark = payload.find(MARK, at, end)
        if mark >= 0:
            end = mark + len(MARK) - 2
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def dechunked(body: bytes) -> bytes | None:
    """What the framing holds; None if it is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        at = line + 2 + size
        if size < 0 or body[at : at + 2] != b"\r\n":
            return None
        out.append(body[line + 2 : at])
        at += 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n%b\r\n%b" % (f"{head}Content-Length: {len(block)}\r\n".encode(), block)


def records_of(page_id: int | None, uri: str, payload: bytes, digest: str, copy: int, first: int | None, date: str, segment: int) -> list[bytes]:
    """A page's records, without the blank lines that end them."""
    uri = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
    own = record_id(page_id, digest, copy)
    kind = [("Content-Type", "application/http;msgtype=response")]
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest, 1))]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *refers, *kind], http)]
    block = http + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind], block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if number == len(parts) else []
        origin = [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own, number)), ("WARC-Date", date), ("WARC-Target-URI", uri), *origin, *last], part))
    return out


def write_archive(pages: DataFrame, path: str, payload: str = "html", date: str = "2024-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Archive files of ``pages(page_id, url, payload)`` in the folder ``path``.

    The digests alone are grouped. Pages that revisit another, or that stand in
    the table more than once, are marked; the marks are broadcast if measured
    small, else the pages move once, by page and digest, where no key is hot.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("uri"), body.alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    slim = written(full.select("page_id", "digest", (F.octet_length("payload") >= REVISIT_BYTES).alias("large")), "warc_digests")
    per = slim.groupBy("page_id", "digest", "large").agg((F.count(F.lit(1)) > 1).alias("again"))
    groups = per.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    groups = broadcast_if_small(written(groups, "warc_groups"), 128)
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marks = per.join(groups, "digest", "left").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), first.alias("first"), "again")
    marks = broadcast_if_small(written(marks.where(F.col("first").isNotNull() | F.col("again")), "warc_marks"), 160)
    placed = full.join(marks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")
    again = F.coalesce("again", F.lit(False))
    columns = ["page_id", "uri", "payload", "digest"]
    copies = Window.partitionBy("page_id", "digest").orderBy("uri")
    rows = (
        placed.where(~again).select(*columns, F.lit(1).alias("copy"), "first")
        .unionByName(placed.where(again).select(*columns, F.row_number().over(copies).alias("copy"), "first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"value": records_of(*row, date, segment)}, pa.schema([("value", pa.binary())]))

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.text(path, compression="gzip", lineSep="\r\n\r\n")


def _parsed(piece: bytes, file: str) -> dict | None:
    """A record's fields from what follows MARK; None if there is no record."""
    end = piece.find(b"\r\n\r\n")
    head = piece[: end if end >= 0 else len(piece)].decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
    if "warc-type" not in fields:
        return None
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    length = number("content-length")
    block = piece[end + 4 :] if end >= 0 else b""
    return {
        "file": file, "record_id": fields.get("warc-record-id"), "type": fields["warc-type"], "page_id": number("x-page-id"), "uri": fields.get("warc-target-uri"),
        "segment": number("warc-segment-number"), "origin": fields.get("warc-segment-origin-id"), "total": number("warc-segment-total-length"),
        "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest"),
        "block": block[:length], "whole": end >= 0 and length is not None and len(block) >= length,
    }


def _parsed_file(data: bytes, file: str) -> Iterator[dict]:
    """The records of a whole file, by their lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = data.find(MARK)
    while at >= 0:
        start = at + len(MARK)
        end = data.find(b"\r\n\r\n", start)
        row = _parsed(data[start : end + 4] if end >= 0 else data[start:], file)
        if row is None or end < 0:
            return
        size = next((int(x[15:]) for x in data[start:end].decode("latin-1").lower().split("\r\n") if x.startswith("content-length:") and x[15:].strip().isdigit()), 0)
        row |= {"block": data[end + 4 : end + 4 + size], "whole": len(data) >= end + 4 + size}
        yield row
        at = data.find(MARK, end + 4 + size)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archive files in ``path``."""

    def pieces(batches: Iterator[pa.RecordBatch], blocks: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for file, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size += len(value)
                if value.strip():
                    row = _parsed(value, file) or dict.fromkeys(_RECORDS.names) | {"file": file, "whole": False}
                    if blocks or not row["whole"]:
                        rows.append(row if blocks else row | {"block": None})
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _RECORDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in _parsed_file(data, file):
                    yield pa.RecordBatch.from_pylist([row], _RECORDS)

    text = spark.read.option("lineSep", MARK.decode()).text(path)
    cut = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    # The first pass looks for broken pieces only; writing the records instead would store the archive twice.
    torn = cut.mapInArrow(lambda batches: pieces(batches, False), RECORDS).select("file").distinct()
    broken = [r["file"] for r in torn.collect()]  # names of files
    if not broken:
        return cut.mapInArrow(lambda batches: pieces(batches, True), RECORDS)
    again = spark.read.format("binaryFile").load(broken).select("path", "content").mapInArrow(files, RECORDS)
    return cut.where(~F.col("file").isin(broken)).mapInArrow(lambda batches: pieces(batches, True), RECORDS).unionByName(again)


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their whole payload: continuations joined, framing removed, digest compared."""
    columns = ["record_id", "type", "page_id", "uri", "refers_to", "digest", "block"]
    single = records.where(F.col("segment").isNull()).select(*columns, F.col("whole").alias("complete"))
    parts = records.where(F.col("segment").isNotNull())
    first = F.col("segment") == 1
    grouped = parts.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in columns[1:-1]],
        # One record's segments; a segment that was stored twice counts once.
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.min("whole").alias("whole"),
    )
    numbers, blocks = F.col("parts")["segment"], F.col("parts")["block"]
    length = F.aggregate(F.transform(blocks, F.octet_length), F.lit(0).cast("long"), lambda a, n: a + n)
    gapless = numbers == F.sequence(F.lit(1), F.size("parts"))
    block = F.aggregate(blocks, F.lit(b""), lambda a, b: F.concat(a, b))
    complete = F.coalesce(F.col("whole") & gapless & (length == F.col("total")), F.lit(False))
    joined = grouped.select(*columns[:-1], F.when(complete, block).alias("block"), complete.alias("complete"))
    both = single.unionByName(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [payload_of(b, t) if ok else None for b, t, ok in zip(*(batch.column(c).to_pylist() for c in ("block", "type", "complete")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(7), pa.array(payloads, pa.binary())], [*columns[:-1], "complete", "payload"])

    schema = "record_id string, type string, page_id long, uri string, refers_to string, digest string, complete boolean, payload binary"
    decoded = both.mapInArrow(run, schema)
    hashed = decoded.withColumn("sha256", F.sha2("payload", 256))
    right = F.col("digest").isNull() | (F.col("type") != "response") | (F.col("digest") == F.concat(F.lit("sha256:"), F.col("sha256")))
    complete = F.col("complete") & F.coalesce(right, F.lit(False))
    return hashed.select(*columns[:-1], complete.alias("complete"), F.when(complete, F.col("payload")).alias("payload"), "sha256")


def payload_of(block: bytes, kind: str) -> bytes | None:
    """The payload of an HTTP response block; None if its framing is broken."""
    if kind == "revisit":
        return b""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return block
    if not blank:
        return None
    framed = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(b"\r\n"))
    return dechunked(body) if framed else body


def page_facts(payloads: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of reassembled records; revisits take their response's."""
    slim = payloads.select("record_id", "type", "page_id", F.col("refers_to").alias("target"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("sha256").alias("payload_digest"))
    slim = written(slim.where(F.col("type").isin("response", "revisit")), "warc_payloads")
    names = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    responses = slim.where(F.col("type") == "response")
    revisits = slim.where(F.col("type") == "revisit").select("page_id", "type", "target")
    used = responses.join(revisits.select(F.col("target").alias("record_id")).distinct(), "record_id", "left_semi")
    used = written(used.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"), "warc_targets")
    seen = revisits.join(broadcast_if_small(used, 192), F.col("target") == F.col("record_id"), "left")
    own = responses.withColumn("refers_to", F.lit(None).cast("long"))
    return own.select(*names).unionByName(seen.select(*names))


def round_trip(pages: DataFrame, payload: str = "html", segment: int = SEGMENT) -> DataFrame:
    """Writes ``pages`` to an archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/lintmill/{uuid.uuid4().hex}/warc"
    write_archive(pages, path, payload, segment=segment)
    return reassemble(read_records(spark, path))
