"""WARC archives: segmented, chunked records written from pages and reassembled.

``write_archives`` turns every page into a record: a ``response`` with the page
as an HTTP message in chunked transfer coding, or a ``revisit`` that refers to
the response with the same payload. A record's block longer than
``segment_bytes`` goes on in ``continuation`` records. Each task writes one
gzip file, which a reader takes from its start, so that ``Content-Length``
frames every record whatever bytes a payload holds.

``read_segments`` parses the archives, ``reassemble`` groups continuations by
the origin's record id, orders them by segment number, checks the numbers and
the total length, and decodes the chunks. Only segmented records move; a task
holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import small_batches, stage, utf8

CRLF = b"\r\n"
BLANK = b"\r\n\r\n"

SEGMENT = ("record_id string, warc_type string, page_id bigint, url string, payload_digest string, "
           "refers_to_id string, refers_to bigint, origin_id string, segment int, total_bytes bigint, "
           "truncated boolean, block binary")
RECORD = ("record_id string, page_id bigint, url string, record_type string, payload_digest string, "
          "refers_to bigint, segments int, error string, payload binary")


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """The payload in chunked transfer coding (RFC 9112, section 7.1)."""
    out = []
    for i in range(0, len(payload), chunk_bytes):
        part = payload[i:i + chunk_bytes]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", BLANK])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped.

    Raises ValueError where the framing is broken or the last chunk is missing."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size line is not ended")
        size_text = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size_text):
            raise ValueError("chunk size is not hexadecimal")
        size, at = int(size_text, 16), end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk is shorter or longer than its size")
        out.append(body[at:at + size])
        at += size + 2


def header_block(first: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + BLANK


def _uri(url: str | None) -> str:
    """A header value must stay on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record_bytes(kind: str, record_id: str, page_id, url, digest: str, refers, block: bytes,
                 segment_bytes: int) -> list[bytes]:
    """A record and its continuations as they stand in the archive."""
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)] or [b""]
    out = []
    for i, part in enumerate(parts, 1):
        first, more = i == 1, len(parts) > 1
        fields = [("WARC-Type", kind if first else "continuation"),
                  ("WARC-Record-ID", f"<{record_id}>" if first else f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{i}').urn}>"),
                  ("WARC-Target-URI", _uri(url) if url is not None else None),
                  ("X-Page-ID", page_id if first else None),
                  ("WARC-Payload-Digest", f"sha256:{digest}" if first else None),
                  ("WARC-Refers-To", f"<{refers[0]}>" if first and refers else None),
                  ("X-Refers-To-Page-ID", refers[1] if first and refers else None),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers and first else None),
                  ("WARC-Segment-Origin-ID", None if first else f"<{record_id}>"),
                  ("WARC-Segment-Number", i if more else None),
                  ("WARC-Segment-Total-Length", len(block) if more and i == len(parts) else None),
                  ("Content-Type", "application/http; msgtype=response" if first else None),
                  ("Content-Length", len(part))]
        out.append(header_block("WARC/1.1", fields) + part + BLANK)
    return out


def response_id(page_id, digest: str) -> str:
    """The record id of a page's response, so that revisits can name it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}").urn


def _written(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for b in small_batches(batches):
            rows = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "first_id", "copy")),
                       utf8(b, "html"))
            records = []
            for page_id, url, digest, first_id, copy, html in rows:
                n += 1
                own = response_id(page_id, digest)
                if copy or first_id is not None:  # rows after the first of an id need another name
                    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{own}/{task.partitionId()}/{n}").urn
                http = [("Content-Type", "text/html; charset=utf-8"), ("Transfer-Encoding", "chunked")]
                head = header_block("HTTP/1.1 200 OK", http)
                if first_id is None:
                    records += record_bytes("response", own, page_id, url, digest, None,
                                            head + chunked(html, chunk_bytes), segment_bytes)
                else:
                    records += record_bytes("revisit", own, page_id, url, digest,
                                            (response_id(first_id, digest), first_id), head, segment_bytes)
            # Spark's text writer ends each row with the line feed that ends a record
            yield pa.record_batch([pa.array([r[:-1] for r in records], pa.binary())], names=["value"])
    return run


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 100, segment_bytes: int = 4096,
                   chunk_bytes: int = 1024) -> None:
    """One record per row of ``pages`` (page_id, url, html), gzip files in ``path``.

    Of equal payloads of ``min_revisit_bytes`` or more the smallest page_id is
    the response and the others are revisits of it; rows that repeat both id
    and payload, and rows without an id, are responses of their own. A null
    html is an empty payload, a null url or id leaves its field out.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2("html", 256)
    keyed = stage(pages.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n")), "page-digests")
    # only payloads that more than one page has; partial sums first, so a common payload is a row per task
    shared = stage(keyed.filter((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull())
                   .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
                   .filter("first_id < last_id").select("digest", "first_id"), "page-firsts")
    refers = (keyed.join(shared, "digest").filter("page_id > first_id")
              .select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first_id").distinct())
    repeated = keyed.groupBy("page_id", "digest").count().filter("count > 1 or page_id is null").select(
        F.col("page_id").alias("id"), F.col("digest").alias("d"), F.lit(True).alias("copy"))
    # written, so that Spark knows their size: pages move only if the notes on them are many
    notes = stage(refers.unionByName(repeated, allowMissingColumns=True).groupBy("id", "d").agg(
        F.max("first_id").alias("first_id"), F.max("copy").alias("copy")), "page-notes")
    (pages.withColumn("digest", digest)
     .join(notes, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
     .select("page_id", "url", "html", "digest", "first_id", F.coalesce("copy", F.lit(False)).alias("copy"))
     .mapInArrow(_written(segment_bytes, chunk_bytes), "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").text(path))


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines join the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _segment(head: bytes, block: bytes, truncated: bool) -> tuple:
    f = parse_fields(head)
    bare = lambda k: f[k].strip("<>") if k in f else None
    number = lambda k: int(f[k]) if re.fullmatch(r"-?\d+", f.get(k, "")) else None
    return (bare("warc-record-id"), f.get("warc-type"), number("x-page-id"), f.get("warc-target-uri"),
            f.get("warc-payload-digest", "").removeprefix("sha256:") or None, bare("warc-refers-to"),
            number("x-refers-to-page-id"), bare("warc-segment-origin-id"), number("warc-segment-number"),
            number("warc-segment-total-length"), truncated, block)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are the pieces between blank lines, in file order. A piece that
    begins a record is its head; pieces are then joined until Content-Length
    bytes are there."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
             pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    head, parts, have, want, out = None, [], 0, 0, []

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)

    for b in batches:
        for piece in utf8(b, "value"):
            if head is None:
                piece = piece.lstrip(b"\r\n")
                if not piece.startswith(b"WARC/"):
                    continue  # padding after a record's end
                head, parts, have = piece, [], 0
                length = parse_fields(head).get("content-length", "")
                want = int(length) if length.isdigit() else 0
                continue
            have += len(piece) + (len(BLANK) if parts else 0)
            parts.append(piece)
            if have >= want:
                block = BLANK.join(parts)
                out.append(_segment(head, block[:want], False))
                # a block that ends with CRLF hides the blank line before the next head
                rest = block[want:].lstrip(b"\r\n")
                head, parts, have = (rest, [], 0) if rest.startswith(b"WARC/") else (None, [], 0)
                if head is not None:
                    length = parse_fields(head).get("content-length", "")
                    want = int(length) if length.isdigit() else 0
        if out:
            yield made()
            out = []
    if head is not None:  # the archive ends inside a record
        out.append(_segment(head, BLANK.join(parts), True))
        yield made()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzip archives, continuations as rows of their own.

    Gzip files are not split, so a task reads a file from its first byte."""
    return (spark.read.option("lineSep", BLANK.decode()).text(path)
            .select(F.col("value").cast("binary").alias("value")).mapInArrow(_parsed, SEGMENT))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number: one record per origin."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
    held: list[dict] = []

    def record() -> tuple:
        # a record that was archived twice has equal copies of its segments
        by_number = {s["segment"] or 1: s for s in held}
        first, error, body = by_number.get(1), None, b""
        if first is None:
            error, first = "origin segment is missing", held[0]
        elif any(s["truncated"] for s in by_number.values()):
            error = "archive ends inside the record"
        elif sorted(by_number) != list(range(1, len(by_number) + 1)):
            error = "segment numbers have a gap"
        block = b"".join(by_number[k]["block"] for k in sorted(by_number))
        last = by_number[max(by_number)]
        if not error and first["segment"] is not None and last["total_bytes"] != len(block):
            error = "total length differs from the segments' bytes"
        if not error and first["warc_type"] == "response":
            head, found, body = block.partition(BLANK)
            if not found:
                error = "no HTTP header"
            elif "chunked" in parse_fields(head).get("transfer-encoding", "").lower():
                try:
                    body = dechunked(body)
                except ValueError as e:
                    error = str(e)
            if not error and first["payload_digest"] not in (None, hashlib.sha256(body).hexdigest()):
                error = "payload differs from its digest"
        payload = body if first["warc_type"] == "response" and not error else None
        return (first["record_id"], first["page_id"], first["url"], first["warc_type"], first["payload_digest"],
                first["refers_to"], len(by_number), error, payload)

    def made(rows) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    out = []
    for b in small_batches(batches):
        for row in b.to_pylist():
            if held and held[0]["origin"] != row["origin"]:
                out.append(record())
                held = []
            held.append(row)
        yield made(out)
        out = []
    if held:
        yield made([record()])


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records of ``segments``: record_id, page_id, url, record_type,
    payload_digest, refers_to, segments, error (null: sound) and payload (of
    sound responses). A record whose parts are missing, cut or differ from
    their stated length or digest comes with the reason and without payload."""
    named = segments.withColumn("origin", F.coalesce("origin_id", "record_id"))
    whole = named.filter(F.col("segment").isNull())
    parts = named.filter(F.col("segment").isNotNull()).repartition("origin").sortWithinPartitions("origin", "segment")
    return whole.mapInArrow(_assembled, RECORD).unionByName(parts.mapInArrow(_assembled, RECORD))


def restored_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per record;
    a revisit's payload is that of the response with its digest."""
    found = stage(records.select("page_id", "record_type", "refers_to", "error", F.octet_length("payload").cast("long").alias("bytes"),
                                 F.coalesce(F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)),
                                            "payload_digest").alias("payload_digest")), "warc-records")
    # the targets are as many as there are payloads with revisits, at most
    wanted = found.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    targets = stage(found.filter("record_type = 'response'").alias("a")
                    .join(wanted.alias("w"), (F.col("a.page_id") == F.col("w.refers_to"))
                          & (F.col("a.payload_digest") == F.col("w.payload_digest")))
                    .groupBy(F.col("a.page_id").alias("t_id"), F.col("a.payload_digest").alias("t_digest"))
                    .agg(F.max("bytes").alias("t_bytes")), "warc-targets")
    return (found.join(targets, (F.col("refers_to") == F.col("t_id")) & (F.col("payload_digest") == F.col("t_digest")), "left")
            .select("page_id", F.coalesce("bytes", "t_bytes").alias("payload_bytes"), "payload_digest",
                    "record_type", "refers_to", "error"))
