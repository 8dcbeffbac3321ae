"""WARC archives: a writer of plain records with revisits, and a reader that salvages what it can.

Records are made of column expressions and written by Spark's text writer, whose line separator is
the CRLF pair that ends a record; files go where ``path`` says. The reader checks each record: the
version line, the header fields, the length, the final CRLF pair and the digest. After a failed
check it searches for the next gzip member or version line that passes all checks, goes on from
there, and logs the bytes between as a quarantined gap. It reads plain files and gzip members alike;
inside a member, damaged or cut short as it may be, it goes on at the next version line.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import BROADCAST_ROWS, cut, parts, shared_dir

#: Payloads of so many bytes or more are stored once.
LEAST = 1000
#: Bytes of payload in one archive file, about, and sizes of pages that are written apart: files of larger pages hold fewer. A larger page is a file of its own.
FILE_BYTES, SIZES = 128 << 20, (1 << 15, 1 << 20, 1 << 24)
#: Bytes in which the head of a record ends; more are damage.
HEAD = 1 << 24
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(value, bytes): the WARC record of each row (page_id, url, html), without the CRLF pair at its end, and its payload's length.

    Of rows with equal payloads of ``LEAST`` bytes or more, that with the largest page_id is the
    response and the others are revisits of it. Rows that repeat the largest page_id too are all
    responses. A null html is an empty payload; without a url there is no target; a null page_id has
    an empty name and never stands for others.
    """
    body = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    body = body.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    shared = body.where((F.col("bytes") >= LEAST) & F.col("page_id").isNotNull()).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(shared)
    body = body.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("first"))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(http.cast("binary")))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    return body.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"), "bytes")


def write_archives(pages: DataFrame, path: str | None = None, date: str = DATE) -> str:
    """Write the records of ``pages`` below ``path`` (by default in the shared folder), and return the path.

    Pages of each class of ``SIZES`` go to files of their own, of so many records that a file has ``FILE_BYTES`` at
    most, or one record: a reader holds a file whole.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    made, bounds = records(pages, date), [0, *SIZES, None]
    classes = [F.col("bytes") >= low if high is None else (F.col("bytes") >= low) & (F.col("bytes") < high) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
    here = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")).agg(*(F.bool_or(c) for c in classes)).first()
    for present, test, high in zip(here, classes, bounds[1:], strict=True):
        if present or high == SIZES[0]:  # a folder is there even for an empty table
            few = max(1, FILE_BYTES // high) if high else 1
            made.where(test).select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", few).text(f"{path}/upto-{high or 'more'}")
    return path


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _plain(data: bytes, at: int, rest: int = 0) -> Record | str | None:
    """The record at ``at``, or why there is none; None if that takes some of the ``rest`` bytes that follow ``data``."""
    if not _VERSION.match(data, at):
        return "no version line" if len(data) - at >= 10 or not rest else None
    blank = data.find(b"\r\n\r\n", at)
    if blank < 0:
        return "header without end" if not rest or len(data) - at > HEAD else None
    fields: dict[str, str] = {}
    for line in bytes(data[at:blank]).split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not all(k in fields for k in ("warc-type", "warc-record-id", "content-length")) or not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        return "missing fields"
    start, size = blank + 4, int(fields["content-length"])
    if start + size > len(data) + rest:
        return "block cut short"
    if start + size + 4 > len(data) and rest:
        return None
    block = bytes(data[start : start + size])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        return "no end of record"
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        cut_at = block.find(b"\r\n\r\n")
        if cut_at < 0:
            return "no HTTP header"
        payload = block[cut_at + 4 :]
        for line in block[:cut_at].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == b"content-length":
                fields["payload-bytes"] = value.strip().decode("ascii", "replace")
    for key, part in (("warc-block-digest", block), *([("warc-payload-digest", payload)] if fields["warc-type"] != "revisit" else [])):
        said = fields.get(key, "")
        if said.startswith("sha1:") and len(said) == 45 and hashlib.sha1(part).hexdigest() != said[5:]:
            return f"{key} differs"
    return Record(at, start + size + 4, fields, payload)


def _single(data: bytes, at: int) -> tuple[int, list[Record | Gap], str]:
    """The end of the plain record at ``at`` and the record, or why there is none."""
    got = _plain(data, at)
    return (got.end, [got], "") if isinstance(got, Record) else (at, [], str(got))


def _inflate(data: bytes, at: int) -> Generator[bytes, None, tuple[int, str]]:
    """What can be read of the gzip member at ``at``, part by part; returns where it stops, and why if that is not its end."""
    z, step = zlib.decompressobj(31), 1 << 14
    while at < len(data) and not z.eof:
        kept = z.copy()
        try:
            part = z.decompress(data[at : at + step])
        except zlib.error as e:
            if step == 1:
                return at, str(e)
            z, step = kept, max(1, step // 16)
            continue
        yield part
        at = min(at + step, len(data))
    return at - len(z.unused_data), "" if z.eof else "member cut short"


def _extent(data: bytes, at: int) -> tuple[int, int, str]:
    """Of the gzip member at ``at``: how many bytes it has inflated, where it stops, and why if that is not its end."""
    size, steps = 0, _inflate(data, at)
    while True:
        try:
            size += len(next(steps))
        except StopIteration as done:
            return size, *done.value


def _within(data: bytes, at: int, size: int, end: int, failed: str, why: list[str]) -> Iterator[Record | Gap]:
    """The records of the gzip member at ``at`` and the gaps between them, through a window that holds one record or the place where the next is sought.

    All have the bounds of the member, or of the part that can be read. Without a single record the member is no member: nothing
    comes out but the reason, in ``why``.
    """
    steps, window, base, pos = _inflate(data, at), bytearray(), 0, 0
    bad, reason, early, any_record = 0, "", [], False

    def gap(upto: int) -> Gap:
        return Gap(at, end, f"bytes {bad} to {upto} of the member: {reason}")

    while pos < size:
        got = _plain(window, pos - base, size - base - len(window))
        if got is None:  # twice what is here, or all
            want = 2 * (len(window) - pos + base) + (1 << 16)
            del window[: pos - base]
            base = pos
            while len(window) < want and (part := next(steps, None)) is not None:
                window += part
            continue
        if isinstance(got, Record):
            if reason:
                early.append(gap(pos))
                reason = ""
            yield from early
            early, any_record, pos = [], True, base + got.end
            got.start, got.end = at, end
            yield got
            continue
        if not reason:
            bad, reason = pos, got
        seek = pos + 1
        while not (found := _VERSION.search(window, seek - base)):
            seek = max(seek, base + len(window) - 9)  # a version line may begin here
            del window[: seek - base]
            base = seek
            if (part := next(steps, None)) is None:
                break
            window += part
        pos = base + found.start() if found else size
    if not any_record and (failed or reason):
        why.append(failed or reason)
    elif reason and not failed:  # the rest of a member that fails is part of the gap after it
        yield gap(size)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, plain or in gzip members of any size, in order, and the gaps between them."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        if data.startswith(b"\x1f\x8b\x08", at):
            why: list[str] = []
            size, end, failed = _extent(data, at)
            found = _within(data, at, size, end, failed, why)
            first = next(found, None)
            got = chain([] if first is None else [first], found)
            if why:
                end, failed = at, why[0]
            some = first is not None
        else:
            end, got, failed = _single(data, at)
            some = bool(got)
        if bad is not None and (some or not failed):
            yield Gap(bad, at, reason)
            bad = None
        yield from got
        if failed:
            if bad is None:
                bad, reason = at, failed
            after = _NEXT.search(data, at + 1)
            at = after.start() if after else len(data)
        else:
            at = end
    if bad is not None:
        yield Gap(bad, len(data), reason)


READ = "path string, start long, end long, kind string, reason string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record below ``path`` (kind: its WARC type) and for each gap (kind ``gap``, with the reason).

    payload_bytes and payload_digest (bare hex SHA-1) are of the full payload, for revisits too.
    All files count, in folders of any depth, but for those that Spark skips (names with _ or . first).
    Each file is read whole by one task, and has 2 GB at most; ``write_archives`` makes files of ``FILE_BYTES``.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in parts(batches, 1):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for x in salvage(content.as_py()):
                    if isinstance(x, Gap):
                        rows.append((name, x.start, x.end, "gap", x.reason, None, None, None, None, None, None))
                    else:
                        said = x.fields.get("warc-payload-digest", "")
                        full = x.fields["warc-type"] == "revisit"
                        size = x.fields.get("payload-bytes", "")
                        rows.append((name, x.start, x.end, x.fields["warc-type"], None, x.fields["warc-record-id"], x.fields.get("warc-target-uri"), x.fields.get("warc-refers-to"), int(size) if full and size.isdigit() else len(x.payload), said[5:] if said.startswith("sha1:") else hashlib.sha1(x.payload).hexdigest(), x.payload if payloads else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def page_of(name: str) -> Column:
    """The page_id in a record's name."""
    return F.regexp_extract(name, r"<urn:page:(-?\d+)>", 1).try_cast("long")
