r"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing is plain DataFrame work: a record is a row's text, and Spark's text sink writes
WARC files, with the record separator "\r\n\r\n" as its line separator. Of pages with equal
payloads the smallest page_id is a response and the others revisit it. Only digests are
shuffled to find them: those that occur twice are joined back by broadcast up to
BROADCAST_DIGESTS of them, and beyond that by a join whose hot digests are dealt over tasks.
Each task rolls its files by FILE_BYTES.

Reading takes whole files, plain, of gzip members, or of both. A record must have a version line,
headers, its full length, the separator, and the digests that its headers name. Where
any check fails the reader looks for the next valid version line or gzip member and
goes on, within a damaged member too; the bytes between are a row of kind `gap` with the reason.

Null html is an empty payload. A page without an id is always a response, and none refers
to it. Rows that repeat a page_id and its payload are all responses. An empty table gives no
record. A file must fit a task's memory; one record is never split. Columns besides page_id, url
and html play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attached, checkpoint, read, shared_dir

SEPARATOR, FILE_BYTES, LEAST_REVISIT_BYTES = "\r\n\r\n", 32 << 20, 0
BROADCAST_DIGESTS = 200_000  # a digest and an id have 28 bytes
ROWS = "archive string, start long, end long, kind string, reason string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, from built-in functions."""
    digits = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(key, first): the SHA-1 of every payload that occurs twice or more, and the smallest page_id that has it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", payload.alias("payload")).where((F.octet_length("payload") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull())
    known = known.select("page_id", F.unhex(F.sha1(F.col("payload").cast("binary"))).alias("key"))
    return known.groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where(F.col("last") > F.col("first")).select("key", "first")


def records(pages: DataFrame) -> DataFrame:
    """One WARC record, a string, for every row of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).alias("size"), base32_sha1(payload.cast("binary")).alias("digest"), F.unhex(F.sha1(payload.cast("binary"))).alias("own"))
    same = (F.col("own") == F.col("key")) & (F.col("page_id") > F.col("first"))
    rows = attached(rows, checkpoint(first_pages(pages)), same, BROADCAST_DIGESTS, "page_id")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("block", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
            _header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
            _header("WARC-Target-URI", F.col("url")),
            F.when(revisit, F.concat(_header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first"), F.lit(">"))))).otherwise(""),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block").cast("binary")))),
            _header("Content-Type", F.lit("application/http; msgtype=response")),
            _header("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("record")
    )


def write(pages: DataFrame, folder: str) -> None:
    """Writes the pages' records, each task to files of about FILE_BYTES."""
    rows = records(pages)
    size, tasks = pages.select(F.octet_length("html").alias("n"), F.spark_partition_id().alias("task")).agg(F.sum("n"), F.max("task") + 1).first()
    files = -(-(size or 0) // (FILE_BYTES * (tasks or 1)))
    out = rows.write.option("lineSep", SEPARATOR)
    if files > 1:  # a task deals its records over so many files
        out = rows.select("record", F.pmod(F.xxhash64("record"), F.lit(files)).alias("roll")).write.option("lineSep", SEPARATOR).partitionBy("roll")
    out.text(folder)


_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_NEXT = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[01]\r?\n")
_HEADERS_END = re.compile(rb"\r\n\r\n|(?<=\n)WARC/1\.[01]\r?\n")
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[01]\r?\n|\x1f\x8b\x08")
FIRST_PIECE, PIECE = 1 << 8, 1 << 16  # bytes of a gzip member that are inflated at once, at first and at most
_PAGE, _SIZE = re.compile(r"<urn:page:(-?[0-9]{1,18})>"), re.compile(r"[0-9]{1,18}")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Bad(Exception):
    """Why a record can't be read."""


def record(data: bytes, at: int) -> tuple[int, dict]:
    """The end of the record at `at`, and its fields."""
    m = _VERSION.match(data, at)
    if not m:
        raise Bad("no version line")
    # no header is searched for twice: the search ends at the next version line, which is the next place to try
    until = _HEADERS_END.search(data, m.end() - 2)
    if until is None:
        raise Bad("headers don't end")
    if until[0] != b"\r\n\r\n":
        raise Bad("a version line among the headers")
    end = until.start()
    headers = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("a header without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not _SIZE.fullmatch(length):
        raise Bad("no length")
    start, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        raise Bad("cut short")
    if data[stop : stop + 4] != b"\r\n\r\n" and stop < len(data):
        raise Bad("no separator after the block")
    block = data[start:stop]
    if (named := headers.get("warc-block-digest", "")).startswith("sha1:") and named[5:] != digest(block):
        raise Bad("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n")
    named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers.get("warc-type", "")
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})", head)
        size, found = int(m[1]) if m else None, named
    else:
        size, found = len(payload), digest(payload)
        if named and named != found:
            raise Bad("payload digest differs")
    page, refers = (_PAGE.search(headers.get(h, "")) for h in ("warc-record-id", "warc-refers-to"))
    return min(stop + 4, len(data)), {"page_id": int(page[1]) if page else None, "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload_bytes": size, "payload_digest": found}


def _no_header(data: bytes, at: int) -> str:
    """Why the bytes from the magic on are no header of a gzip member and the first bits of its content; empty if they are. A name or comment has PIECE bytes at most."""
    if at + 10 >= len(data):
        return "cut short"
    flags, end = data[at + 3], at + 10
    if flags & 0xE0:
        return "gzip: reserved flags"
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            end = data.find(b"\0", end, end + PIECE) + 1
            if not end:
                return "gzip: the header doesn't end"
    end += 2 if flags & 2 else 0
    if end < len(data) and data[end] & 6 == 6:
        return "gzip: no such kind of block"
    return ""


def member(data: bytes, at: int) -> tuple[int | None, bytes, str]:
    """The end of the gzip member at `at`, its content and why it is damaged; a damaged one has no end, and the content that precedes its error."""
    if data[at : at + 3] != _GZIP:
        raise Bad("no gzip member")
    if why := _no_header(data, at):
        return None, b"", why
    z, out, view, place, size = zlib.decompressobj(31), [], memoryview(data), at, FIRST_PIECE
    try:
        while place < len(data) and not z.eof:
            step, size = view[place : place + size], min(2 * size, PIECE)
            held = z.copy()
            place += len(step)
            out.append(z.decompress(step))
    except zlib.error as e:
        while len(step) > 1:  # by halves, up to the byte of the error
            half, before = len(step) // 2, held.copy()
            try:
                out.append(held.decompress(step[:half]))
                step = step[half:]
            except zlib.error:
                held, step = before, step[:half]
        return None, b"".join(out), f"gzip: {e}"
    if not z.eof:
        return None, b"".join(out), "cut short"
    return place - len(z.unused_data), b"".join(out), ""


def _plain(data: bytes):
    """(start, end, fields or None, reason) for every record and every gap of uncompressed data, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            end, fields = record(data, at)
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            m = _NEXT.search(data, at + 1)
            if m is None:
                break
            at = m.start()
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield at, end, fields, ""
        at = end
    if gap is not None:
        yield gap, len(data), None, reason


def salvage(data: bytes):
    """(start, end, fields or None, reason) for every record and every gap, in order; places are those of the file's bytes.

    Records of a gzip member have the member's place, damaged or not. A gap inside a member has its
    place too, and the reason names the bytes of its content.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        rows, stop, why = [], None, ""
        if data.startswith(_GZIP, at):
            stop, content, why = member(data, at)
            rows = [(a, b, f, "" if f else f"{inner}, content bytes {a} to {b}") for a, b, f, inner in _plain(content)]
            if stop is None and any(f for _, _, f, _ in rows):  # damaged, but not lost
                m = _START.search(data, at + 1)
                stop = m.start() if m else len(data)
                if rows[-1][2]:
                    rows.append((0, 0, None, f"{why}, content bytes {len(content)} on"))
            rows = [(at, stop, f, inner) for _, _, f, inner in rows]
        else:
            try:
                stop, fields = record(data, at)
                rows = [(at, stop, fields, "")]
            except Bad as e:
                why = str(e)
        if stop is None:
            if gap is None:
                gap, reason = at, why
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield from rows
        at = stop
    if gap is not None:
        yield gap, len(data), None, reason


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every record (kind `record`) and every gap (kind `gap`) of a folder's archives."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [{"archive": path, "start": s, "end": e, "kind": "record" if f else "gap", "reason": why or None, **(f or {})} for s, e, f, why in salvage(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, ROWS)


_SCHEMA = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in ROWS.split(", "))])


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
v AS (SELECT page_id, payload_bytes, x, [CAST('0x' || substr(x, 5*i+1, 5) AS BIGINT) FOR i IN range(0,8)] AS fives FROM d),
b AS (SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> (5*k)) & 31 AS BIGINT) + 1, 1) FOR k IN [3,2,1,0]], '') FOR n IN fives], '') AS payload_digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
