"""WARC archives: writing deduplicated records and a reader that salvages damaged files.

Each record is a gzip member of its own, so a damaged one costs no other.  The
reader checks every member and record; after a failed check it searches for the
next gzip member or version line, goes on from there, and reports the bytes in
between as a quarantined gap.  A member of several records is searched in the
same way: records before and after a damaged one are kept, and of a member that
is cut off or corrupt, those that had been unpacked before.

Files are bounded by bytes, not by rows: records are put together to blocks of
about BLOCK_BYTES, and a file has BLOCKS of them, so a file holds 64 MB and at
most BLOCKS records beyond.  A file is read whole by one task; those of others
may have up to the 2 GB that Spark's reader allows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.llm.common import cut, drop_dir, shared_dir, table

# Fixed values of the two formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
#: An empty gzip member; it stands between the rows of a text file, whose writer needs a separator.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300" "00000000" "00000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes given to the decompressor at first, and at most, at once: a false start fails within the first few.
STEPS = 1_024, 262_144
#: Bytes after which a block of records ends, and blocks of one archive file.
BLOCK_BYTES, BLOCKS = 8_000_000, 8


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, target: int | None) -> bytes:
    """A response record, or a revisit of page ``target`` with the HTTP head only; the head tells the full payload's length either way."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if target is not None else http + payload
    fields = [("WARC-Type", "response" if target is None else "revisit"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    if target is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{target}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record, or a gap if ``reason`` is set.

    ``start`` and ``end`` are offsets in the file, those of the whole member if
    it is compressed; ``inner`` is then the range in the unpacked bytes.
    """

    start: int
    end: int
    reason: str | None = None
    fields: dict[str, str] | None = None
    block: bytes = b""
    inner: tuple[int, int] | None = None


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, compressed by member or not, and the gaps between them.

    A member without records (an empty one) is neither.  Of a member that does
    not unpack to its end, records that pass their checks are kept and the
    member's bytes are also a gap, up to the next member or version line.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        got, nxt, reason = _one(data, at)
        if bad is not None and (got or reason is None):
            yield Found(bad, at, why)
            bad = None
        yield from got
        if reason is None:
            at = nxt
            continue
        if bad is None:
            bad, why = at, reason
        at = _next(data, at + 1)
    if bad is not None:
        yield Found(bad, len(data), why)


def _next(data: bytes, at: int) -> int:
    """The next place that looks like a member or a version line."""
    a = data.find(MAGIC, at)
    m = VERSION.search(data, at, a if a >= 0 else len(data))
    return m.start() if m else a if a >= 0 else len(data)


def _one(data: bytes, at: int) -> tuple[list[Found], int, str | None]:
    """What starts at ``at``, the place after it, and the reason if a check of the whole failed."""
    if data.startswith(MAGIC, at):
        plain, nxt, reason = _unpacked(data, at)
        found = [Found(at, nxt, why, fields, block, (a, b)) for a, b, why, fields, block in _searched(plain)]
        return [f for f in found if not reason or f.reason is None], nxt, reason
    if VERSION.match(data, at):
        fields, block, nxt, reason = _record(data, at)
        return [Found(at, nxt, None, fields, block)] if not reason else [], nxt, reason
    return [], at, "no member or version line"


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The bytes of the member at ``at``, as far as they can be had, the place after it, and the reason if it has no proper end."""
    unpack, fed, parts, (step, most) = zlib.decompressobj(31), at, [], STEPS
    try:
        while not unpack.eof and fed < len(data):
            parts.append(unpack.decompress(data[fed : fed + step]))
            fed, step = fed + step, min(most, 2 * step)
    except zlib.error as e:
        return b"".join(parts) + _last_bytes(data, at, fed, step), fed, f"gzip: {e}"
    if not unpack.eof:
        return b"".join(parts), len(data), "gzip: cut off"
    return b"".join(parts), min(fed, len(data)) - len(unpack.unused_data), None


def _last_bytes(data: bytes, start: int, fed: int, step: int) -> bytes:
    """What the decompressor gives, byte by byte, of the step that it failed in."""
    unpack, out = zlib.decompressobj(31), []
    unpack.decompress(data[start:fed])
    try:
        for k in range(fed, min(fed + step, len(data))):
            out.append(unpack.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _searched(plain: bytes) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes]]:
    """Records and gaps of unpacked bytes: (start, end, reason, fields, block)."""
    at, bad, why = 0, None, ""
    while at < len(plain):
        fields, block, nxt, reason = _record(plain, at)
        if reason is None:
            if bad is not None:
                yield bad, at, why, None, b""
                bad = None
            yield at, nxt, None, fields, block
            at = nxt
            continue
        if bad is None:
            bad, why = at, reason
        m = VERSION.search(plain, at + 1)
        at = m.start() if m else len(plain)
    if bad is not None:
        yield bad, len(plain), why, None, b""


def _record(data: bytes, at: int):
    """Fields, block and end of the record at ``at``; or the reason why it fails its checks."""
    m = VERSION.match(data, at)
    end = data.find(b"\r\n\r\n", at)
    if not m or end < 0:
        return None, b"", at, "no version line" if not m else "head cut off"
    fields = {}
    for line in data[m.end() : end].decode("utf-8", "surrogatepass" if b"\xed" in data[at:end] else "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            return None, b"", at, "malformed header line"
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit():
        return None, b"", at, "no content length"
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, b"", at, "record cut off"
    block = data[start:stop]
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "").startswith("sha1:"):
        if sha1_base32(payload_of(block)) != fields["warc-payload-digest"][5:]:
            return None, b"", at, "payload digest differs"
    return fields, block, stop + 4, None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head."""
    return block.partition(b"\r\n\r\n")[2]


def http_length(block: bytes) -> int | None:
    m = re.search(rb"(?i)content-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0])
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html) to ``path`` by Spark's own writer.

    Of rows with equal payloads (a null html is empty) that of the largest
    page_id is the response and the others revisit it; repeated rows of that id
    are all responses, and rows whose ids are all null too.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("hash", F.sha1(F.encode("html", "UTF-8")))
    last = rows.groupBy(F.col("hash").alias("its")).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").select("its", "last")
    joined = rows.join(last, F.col("hash") == F.col("its"), "left")
    target = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))

    def pack(batches):
        members: list[bytes] = []
        size = 0
        for batch in batches:
            for i, u, b, t in zip(*batch.columns, strict=True):
                members.append(member(record(i.as_py(), u.as_py(), b.as_py(), t.as_py())))
                size += len(members[-1])
                if size >= block_bytes:
                    yield _block(members)
                    members, size = [], 0
        if members:
            yield _block(members)

    packed = joined.select("page_id", "url", F.encode("html", "UTF-8").alias("body"), target.alias("target")).mapInArrow(pack, "data binary")
    lines = packed.select(F.col("data").cast("string").alias("value"))
    lines.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", blocks).text(path)


def _block(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["data"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every gap of the archives under ``path``.

    Columns: file, start, end, plain_start, plain_end (of what lies in a
    compressed member: its place in the unpacked bytes), gap (the reason, null
    for records), page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (the last two of the full payload, also for revisits) and
    payload (null for revisits).
    """
    schema = "file string, start long, end long, plain_start long, plain_end long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for f in salvage(content.as_py()):
                    rows.append((name.as_py(), f.start, f.end, *(f.inner or (None, None)), f.reason, *(_columns(f) if f.reason is None else (None,) * 7)))
                    size += len(f.block)
                    if len(rows) >= 500 or size >= BLOCK_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(parse, schema)


def _columns(f: Found):
    def number(name):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", f.fields.get(name, ""))
        return int(m[1]) if m else None

    kind = f.fields.get("warc-type", "")
    payload = payload_of(f.block) if kind == "response" else None
    return number("warc-record-id"), f.fields.get("warc-target-uri"), kind, number("warc-refers-to"), http_length(f.block) if payload is None else len(payload), f.fields.get("warc-payload-digest", "")[5:], payload


def _batch(rows):
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["file", "start", "end", "plain_start", "plain_end", "gap", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives in the shared folder and read back; a gap in these archives is an error."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    whole = F.when(F.col("gap").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a gap in "), "file", F.lit(": "), "gap")).cast("boolean"))
    found = cut(read_archives(spark, path).where(whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    drop_dir(spark, path)
    return found


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d"""
