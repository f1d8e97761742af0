"""WARC archives of pages: writing with revisits, reading with segment reassembly.

``write`` makes one record per page, a ``response`` that holds an HTTP message whose body
is framed in chunks, or a ``revisit`` without body where another page has the same
payload. A block over ``segment_bytes`` is cut: the first piece stays in the page's own
record (segment 1), the others are ``continuation`` records that name it as their origin.
Records are written by Spark's text sink with the two line ends that close a record as
its separator; a file holds at most ``RECORDS_PER_FILE`` records, so its size is bounded.

``read`` parses the files side by side. Whole records are decoded where they are; segments
are brought together by their origin's identifier, ordered by segment number, joined if
the numbers are gapless from 1 and the length is the total that the last one states, and
decoded then. Payload digests are verified; a damaged archive raises.

Defined cases: a null html counts as empty; a page_id that occurs twice with the payload
whose largest page_id it is gives two responses; a null page_id is never the largest
unless all are null (then all are responses); a null url has no target header; control
characters and blanks of a url are percent-encoded; an empty table gives an archive
without pages. Other columns are not read. ``read`` gives page_id as text.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 2048
#: Payloads under so many bytes are stored again rather than revisited.
MIN_REVISIT = 1000

_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile("[\x00-\x20\x7f]")
_HEX = re.compile(rb"[0-9A-Fa-f]+")
ROWS = ("page_id string, url string, record_type string, refers_to string, payload binary, "
        "payload_bytes long, payload_digest string")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are left out."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        size = _HEX.fullmatch(body[at:line].split(b";")[0].strip()) if line >= 0 else None
        if not size:
            raise ValueError("a chunk without size")
        n, at = int(size[0], 16), line + 2
        if not n:
            if body[at:at + 2] != b"\r\n" and b"\r\n\r\n" not in body[at:]:
                raise ValueError("no end of the chunked body")
            return b"".join(parts)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("a chunk that does not fill its size")
        parts.append(body[at:at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, its transfer framing decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    fields = _fields(head.split(b"\r\n")[1:])
    return unchunked(body) if fields.get("transfer-encoding", "").strip().lower() == "chunked" else body


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None),
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive file."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields = _fields(data[at:head].split(b"\r\n")[1:])
        block, after = head + 4, head + 4 + int(fields["content-length"])
        if data[after:after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end at its length")
        yield fields, data[block:after]
        at = after + 4


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(same, first): the payloads of at least ``min_bytes`` that several pages have, by hash,
    and the largest page_id that has each."""
    own = pages.select("page_id", F.sha2("payload", 256).alias("same"), F.octet_length("payload").alias("n"))
    return (own.where(F.col("n") >= min_bytes).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
            .where("copies > 1 AND first IS NOT NULL").select("same", "first"))


def write(pages: DataFrame, path: str, date: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archive of ``pages`` (page_id, url, html) at ``path``; ``date`` (W3C form) is
    the records' date."""
    given = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # Written first, so that the planner knows its bytes: it is broadcast only if they are few.
    first = stored(revisits(given, min_revisit), "revisits")
    marked = (given.withColumn("same", F.sha2("payload", 256)).join(first, "same", "left")
              .select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "payload",
                      F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")),
                             F.col("first").cast("string")).alias("refers_to")))
    archive = uuid.uuid4()

    def named(n: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(archive, f'{TaskContext.get().partitionId()}/{n}')}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out, held = [], 0
            for page, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                page, url, payload, refers = page.as_py(), url.as_py(), payload.as_py(), refers.as_py()
                own, n = named(n), n + 1
                about = [("WARC-Record-ID", own), ("WARC-Date", date),
                         ("WARC-Target-URI", url and _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)), ("X-Page-ID", page),
                         ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
                         ("Content-Type", "application/http; msgtype=response")]
                if refers is not None:
                    out.append(_record("revisit", [*about, ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", refers),
                                                   ("X-Payload-Length", len(payload))], _HTTP))
                    held += len(out[-1])
                else:
                    block = _HTTP + chunked(payload)
                    pieces = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
                    held += len(block)
                    if len(pieces) == 1:
                        out.append(_record("response", about, block))
                    else:
                        out.append(_record("response", [*about, ("WARC-Segment-Number", 1)], pieces[0]))
                        for k, piece in enumerate(pieces[1:], 2):
                            last = ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)
                            out.append(_record("continuation", [
                                ("WARC-Record-ID", named(n)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own),
                                ("WARC-Segment-Number", k), last], piece))
                            n += 1
                if held >= 8 << 20:
                    yield pa.record_batch({"record": pa.array(out, pa.binary())})
                    out, held = [], 0
            if out:
                yield pa.record_batch({"record": pa.array(out, pa.binary())})

    (marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
     .write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _decoded(fields: dict[str, str], block: bytes | None) -> tuple:
    """One row of ``ROWS`` from a record's fields and its whole block."""
    page, url = fields.get("x-page-id"), fields.get("warc-target-uri")
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    stated = base64.b32decode(digest).hex() if kind == "sha1" else None
    if fields["warc-type"] == "revisit":
        length = fields.get("x-payload-length")
        return page, url, "revisit", fields.get("x-refers-to-page-id"), None, length and int(length), stated
    payload = http_payload(block)
    found = hashlib.sha1(payload).hexdigest()
    if stated not in (None, found):
        raise ValueError(f"the payload of page {page} does not have its digest")
    return page, url, "response", None, payload, len(payload), found


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = [_decoded(fields, block) for data in batch.column("content") for fields, block in records(data.as_py())
            if fields["warc-type"] in ("response", "revisit") and "warc-segment-number" not in fields]
    return _batch(rows) if rows else None


def _segments(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows: list[tuple] = []
    for data in batch.column("content"):
        for fields, block in records(data.as_py()):
            if "warc-segment-number" in fields:
                total = fields.get("warc-segment-total-length")
                rows.append((fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields["warc-segment-number"]),
                             total and int(total), list(fields.items()) if fields["warc-type"] == "response" else None, block))
    columns = list(zip(*rows)) or [()] * 5
    return pa.record_batch({
        "origin": pa.array(columns[0], pa.string()), "number": pa.array(columns[1], pa.int64()),
        "total": pa.array(columns[2], pa.int64()), "fields": pa.array(columns[3], pa.map_(pa.string(), pa.string())),
        "block": pa.array(columns[4], pa.binary())})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of origin and number -> rows of ``ROWS``. One record is held at a time."""
    origin, fields, pieces, total = None, None, [], None

    def done() -> tuple:
        if total is None or not fields:
            raise ValueError(f"the first or the last segment of {origin} is missing")
        block = b"".join(pieces)
        if len(block) != total:
            raise ValueError(f"the segments of {origin} have {len(block)} bytes of {total}")
        return _decoded(dict(fields), block)

    for batch in batches:
        rows, held = [], 0
        for row in zip(*(batch.column(c) for c in ("origin", "number", "total", "fields", "block"))):
            own, number, stated, about, block = (x.as_py() for x in row)
            if own != origin:
                if origin is not None:
                    rows.append(done())
                origin, fields, pieces, total = own, None, [], None
            if number != len(pieces) + 1 or total is not None:
                raise ValueError(f"segment {number} of {own} follows {len(pieces)}")
            pieces.append(block)
            fields, total = fields or about, stated
            held += len(block)
            if held >= 8 << 20 and rows:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
    if origin is not None:
        yield _batch([done()])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archive at ``path`` with their payloads (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    segments = map_batches(files, _segments, "origin string, number long, total long, fields map<string,string>, block binary")
    ordered = segments.repartition("origin").sortWithinPartitions("origin", "number")
    return map_batches(files, _whole, ROWS).unionByName(ordered.mapInArrow(_joined, ROWS))


def verify_revisits(found: DataFrame) -> None:
    """Raise if a revisit of ``found`` names a response that is not there or whose payload
    has another digest or length. Copies are counted together before the join."""
    claim = ["refers_to", "payload_digest", "payload_bytes"]
    claims = found.where("record_type = 'revisit'").select(*claim).distinct()
    responses = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *claim[1:]).distinct()
    lost = claims.join(responses, claim, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no response for the revisits of page {lost[0]['refers_to']}")
