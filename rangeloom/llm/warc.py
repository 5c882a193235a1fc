"""WARC archives: writing with revisit records, and a salvage reader that gets past damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm._text import per_row
from rangeloom.shared import new_path, stored

_VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):([^\x00-\x08\x0a-\x1f\x7f]*)")
_BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
#: Digest algorithms that block digests are checked with; blocks with others are taken unchecked.
_CHECKED = ("md5", "sha1", "sha256", "sha512")
_STEP = 1 << 10
_MEMBER = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """A record that passed its checks: place and size of its bytes in the archive, header fields, payload.

    Of a record in a gzip member, place and size are the member's (size 0 if the member is damaged behind the
    record), and ``inner`` is its place in the inflated bytes.
    """

    offset: int
    size: int
    headers: dict[str, str]
    payload: bytes
    inner: int = 0


@dataclass
class Gap:
    """Bytes that belong to no valid record."""

    offset: int
    size: int
    reason: str


def record_bytes(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record: version line, header fields, empty line, payload, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(payload)))])
    return _VERSION + b"\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member; its last byte is 0 (an empty member follows where the length's high byte isn't)."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header fields, payload and end of the record at ``at``, or what is wrong with it."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    stop = data.find(b"\r\n\r\n", line.end() - 2)
    if stop < 0:
        return "header without end"
    headers = {}
    for x in data[line.end() : stop].split(b"\r\n"):
        if not (one := _FIELD.fullmatch(x)):
            return "malformed header field"
        headers[one[1].decode().lower()] = one[2].decode("utf-8", "replace").strip()
    if "warc-type" not in headers or not re.fullmatch(r"<[^<>]+>", headers.get("warc-record-id", "")):
        return "no type or record id"
    if not (length := headers.get("content-length", "")).isdecimal():
        return "no content length"
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "no record end after the payload"
    payload = data[start:end]
    if (digest := headers.get("warc-block-digest")) and not _agrees(digest, payload):
        return "block digest differs"
    return headers, payload, end + 4


def _agrees(digest: str, payload: bytes) -> bool:
    """Whether ``algorithm:value`` is the payload's digest; the value is in hex or base32, in either case."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in _CHECKED:
        return True
    raw = hashlib.new(name, payload).digest()
    return value.strip().upper().rstrip("=") in (raw.hex().upper(), base64.b32encode(raw).decode().rstrip("="))


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Bytes and end of the gzip member at ``at``, and what is wrong with it; zlib checks its CRC and length.

    Of a damaged or cut member, the bytes of the steps before the damage.
    """
    z, view, parts, wrong = zlib.decompressobj(31), memoryview(data), [], None
    while at < len(data) and not z.eof:
        try:
            parts.append(z.decompress(view[at : at + _STEP]))
        except zlib.error as e:
            wrong = f"gzip: {e}"
            break
        at = min(at + _STEP, len(data)) - len(z.unused_data)
    return b"".join(parts), at, wrong or (None if z.eof else "gzip: cut off")


def _in_member(inner: bytes, whole: bool, cut_off: bool) -> tuple[list[tuple[int, dict[str, str], bytes]], str | None]:
    """Records of a member's inflated bytes, each with its place there, and the first thing that is wrong between them.

    Where the member's CRC did not hold, a record counts if its own digest was checked, or if the member is sound
    up to its cut.
    """
    found, wrong, at = [], None, 0
    while at < len(inner):
        got = _parsed(inner, at)
        if isinstance(got, tuple):
            if whole or cut_off or got[0].get("warc-block-digest", "").partition(":")[0].strip().lower().replace("-", "") in _CHECKED:
                found.append((at, got[0], got[1]))
            at = got[2]
            continue
        wrong = wrong or got
        begin = _VERSION_LINE.search(inner, at + 1)
        at = begin.start() if begin else len(inner)
    return found, wrong


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive in order, and the byte gaps between them.

    At each place a record (plain, or with others in a gzip member) is checked in full: gzip CRC, version line, header,
    content length, record end, block digest. After a failed check the next place to try is the next gzip magic
    or version line behind the failed one; the bytes passed over are one quarantined gap, with the first reason. A
    member that is damaged or cut still gives the records before the damage; its bytes are a gap all the same. A sound
    member of which some records are not valid gives the others, and a gap of size 0 with the reason.
    """
    at, n = 0, len(data)
    lost, reason = -1, ""
    while at < n:
        if data.startswith(_MEMBER, at):
            inner, end, bad = _inflated(data, at)
            found, odd = _in_member(inner, bad is None, bad == "gzip: cut off")
            ok = bad is None and (found or not inner)
            if (found or ok) and lost >= 0:
                yield Gap(lost, at - lost, reason)
                lost = -1
            for place, headers, payload in found:
                yield Record(at, end - at if ok else 0, headers, payload, place)
            if ok and odd:
                yield Gap(end, 0, odd)
            bad = bad or odd
        else:
            got = _parsed(data, at)
            ok = isinstance(got, tuple)
            if ok:
                if lost >= 0:
                    yield Gap(lost, at - lost, reason)
                    lost = -1
                end = got[2]
                yield Record(at, end - at, got[0], got[1])
            else:
                bad = got
        if ok:
            at = end
            continue
        if lost < 0:
            lost, reason = at, bad
        begin = _BEGIN.search(data, at + 1)
        at = begin.start() if begin else n
    if lost >= 0:
        yield Gap(lost, n - lost, reason)


@dataclass(frozen=True)
class WarcSpec:
    """``least``: bytes from which equal payloads are written once; ``file_records`` and ``file_bytes``: most records and
    bytes of an archive file; only a record that is longer by itself makes a longer file."""

    least: int = 1000
    file_records: int = 2000
    file_bytes: int = 64_000_000
    level: int = 6


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spec: WarcSpec = WarcSpec()) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: payload is null for pages that revisit another's.

    Digests meet in an exchange of narrow rows, summed in the task first; the join back to the pages is a sort
    merge join of two exchanges, so Spark can split the partition of a hot digest.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    named = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    marked = named.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    keys = marked.where(F.col("bytes") >= spec.least).select("page_id", "digest", "bytes")
    last = stored(keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "warc-revisited")
    old = stored(keys.join(last.hint("merge"), ["digest", "bytes"]).where("page_id < last").select("page_id", "digest", "bytes", F.col("last").alias("refers_to")).distinct(), "warc-revisits")
    joined = marked.join(old, ["page_id", "digest", "bytes"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "bytes", "digest", "refers_to")


def write_archives(plan: DataFrame, path: str, spec: WarcSpec = WarcSpec()) -> None:
    """Write a record per row of ``plan`` as gzip members to files of bounded records and bytes below ``path``.

    Members are made in Python tasks; the files are written by Spark's text writer, which commits them whole and
    works on any file system Spark has. It ends each row with a byte 0: the one that ends every member. Null
    payloads and urls are empty, repeated rows are records of their own; an empty table gives no record.
    A task deals its members to folders ``part=0``, 1... by their running bytes.
    """

    def make() -> Callable:
        part = held = 0

        def row(page_id, url, payload, size, digest, refers_to):
            nonlocal part, held
            key = "" if page_id is None else str(page_id)
            fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Target-URI", re.sub(r"[\x00-\x08\x0a-\x1f\x7f]", " ", url or "")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
            if refers_to is not None:
                fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
            payload = payload or b""
            fields.append(("WARC-Block-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"))
            data = member(record_bytes(fields, payload), spec.level)
            if held and held + len(data) > spec.file_bytes:
                part, held = part + 1, 0
            held += len(data)
            return data[:-1], part

        return row

    members = plan.mapInArrow(per_row(pa.schema([("value", pa.binary()), ("part", pa.int32())]), make), "value binary, part int")
    members.select(F.col("value").cast("string"), "part").write.partitionBy("part").option("lineSep", "\0").option("maxRecordsPerFile", spec.file_records).text(path)


_READ = "file string, kind string, offset long, size long, reason string, headers map<string,string>, payload binary"
_READ_SCHEMA = pa.schema([("file", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("reason", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of the archives below ``path``: ``file, kind (record or gap), offset, size,
    reason, headers, payload``.

    A task holds one archive file and one record at a time; archives are files of bounded size, as
    :func:`write_archives` makes them. Spark refuses a file above 2 GiB with an error (its binary reader's limit), so
    longer ones must be cut at members before. Damage costs the records it touches: those behind it are found again.
    Empty files give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                out: list[tuple] = []
                held = 0
                for x in salvage(data.as_py()):
                    out.append((name.as_py(), "gap", x.offset, x.size, x.reason, None, None) if isinstance(x, Gap) else (name.as_py(), "record", x.offset, x.size, None, list(x.headers.items()), x.payload))
                    held += 0 if isinstance(x, Gap) else len(x.payload)
                    if held > 8_000_000 or len(out) >= 2000:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_SCHEMA.types, strict=True)], schema=_READ_SCHEMA)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records read.

    Size and digest of a response are those of the payload read; a revisit has them in its header.
    """
    key = lambda name: F.regexp_extract(F.col("headers")[name], r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    revisit = F.col("headers")["warc-type"] == "revisit"
    return records.where("kind = 'record'").select(
        number(key("warc-record-id")).alias("page_id"),
        F.when(revisit, F.col("headers")["x-payload-length"].cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring(F.col("headers")["warc-payload-digest"], 6, 40)).otherwise(F.sha1("payload")).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        number(key("warc-refers-to")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, path: str, spec: WarcSpec = WarcSpec()) -> DataFrame:
    """Write ``pages`` to archives below ``path`` and return what the salvage reader finds there, a row per page.

    A null html counts as an empty payload, a null url as an empty one. Of equal payloads of at least ``least``
    bytes the largest page_id is the response; rows that repeat it are responses too. A repeated page_id with
    other html is a page of its own. A null page_id is always a response and comes back null. An empty table gives an
    empty one; other columns are not read.
    """
    write_archives(plan_records(pages, spec=spec), path, spec)
    return page_records(read_archives(pages.sparkSession, path))


def op5_salvage_reader(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM l
"""
