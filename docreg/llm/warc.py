"""Web archives: write pages as WARC records, and read archives back past damage.

Writing: every page is one record, its payload the HTML in UTF-8. Of records with
equal payloads of at least ``least`` bytes the one with the smallest page id is a
``response``, the others are ``revisit`` records that refer to it and hold no
payload. The payload's digest groups the records; only ids and digests are
shuffled, never payloads. Records are text with a fixed end, so Spark's own text
writer makes the archive files, with task commit and any Hadoop file system.

Reading salvages: a record whose checks fail (version line, header lines, length,
record end, payload digest, or a gzip member that does not unpack) is left; the
reader searches for the next version line or gzip member that is valid, goes on
from there, and reports the bytes in between as a quarantined gap. What a gzip
member holds is salvaged in the same way, also what was unpacked of a member that
is cut or breaks off; such a member is a gap of the file beside its records. Only
a member that breaks and holds one record and nothing else is left as a whole:
its checks are that record's checks.

Defined results: a null page is an empty payload; records of equal payloads whose
smallest id is shared by repeated rows are all responses; rows without id are
responses unless an equal payload has an id, and refer to that; an empty table
gives no archive records; a record damaged in its payload is a gap, not a record."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.common import reliable, work_path
from docreg.llm.base import sent

LEAST_BYTES = 100
#: Bytes of payload in one archive file, on average; a file is read as a whole.
ARCHIVE_BYTES = 16_000_000
#: Fixed value: what a revisit of an equal payload is called.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\x00-\x08\x0a-\x1f\x7f]*)")
_MEMBER = b"\x1f\x8b\x08"


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(payload_digest, response_id) of payloads that several records share. Counted
    per digest with partial sums, so a payload of most pages is no hot group."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", F.octet_length(payload).alias("size"), F.sha2(payload, 256).alias("payload_digest"))
    shared = hashed.where(F.col("size") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n"))
    return shared.where((F.col("n") > 1) & F.col("response_id").isNotNull()).select("payload_digest", "response_id")


def records(pages: DataFrame, shared: DataFrame, written: Column | None = None) -> DataFrame:
    """The text of every record, without its end, ``written`` at a time (now). Each has
    an id of its own; that of a record others refer to is its page's alone, so repeated
    rows of such a page share it."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("string").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    ).join(shared, "payload_digest", "left")
    answers = F.col("response_id").cast("string")
    again = answers.isNotNull() & ~F.col("page_id").eqNullSafe(answers)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    size = F.octet_length("payload")
    # an address that holds line ends or other controls is written in percent form
    address = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), F.url_encode("url")).otherwise(F.col("url"))
    named = lambda page: F.concat(F.lit("<urn:page:"), page, F.lit(">"))
    own = F.concat(F.lit("?row="), F.uuid())
    optional = lambda made: F.coalesce(made, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(answers.isNotNull() & ~again, named(answers)).otherwise(F.coalesce(named(F.concat("page_id", own)), F.concat(F.lit("<urn:row"), own, F.lit(">"))))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp() if written is None else written, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        optional(F.when(again, line("WARC-Profile", F.lit(PROFILE)))),
        optional(line("WARC-Target-URI", address)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        optional(F.when(again, line("WARC-Refers-To", named(answers)))),
        line("Payload-Length", size.cast("string")), line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.when(again, 0).otherwise(size).cast("string"), F.lit(_END),
    )
    return rows.select(F.concat(head, F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the archives into a new folder and return it. Without ``path`` it
    lies below the shared work folder."""
    path = path or work_path(pages.sparkSession, "archives")
    shared = reliable(revisits(pages, least))
    size = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")).first()
    per_file = max(1, int(archive_bytes / max(1.0, (size["bytes"] or 0) / max(1, size["n"]))))
    records(pages, sent(shared)).write.option("lineSep", _END).option("maxRecordsPerFile", per_file).text(path)
    return path


class Damage(ValueError):
    """Why a record is not valid."""


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The valid record that begins at a place, and where it ends."""
    start = _VERSION.match(data, at)
    if not start:
        raise Damage("no version line")
    fields: dict[str, str] = {}
    line, end = start.end(), data.find(b"\r\n", start.end())
    # line by line, so a header may be of any length and the first line that is none ends the search
    while end != line:
        if end < 0:
            raise Damage("header does not end")
        field = _FIELD.fullmatch(data, line, end)
        if not field:
            raise Damage("malformed header line")
        try:
            fields[field[1].lower().decode()] = field[2].decode()
        except UnicodeDecodeError as problem:
            raise Damage("malformed header line") from problem
        line, end = end + 2, data.find(b"\r\n", end + 2)
    if not fields.get("content-length", "").isdigit():
        raise Damage("no length")
    body, stop = end + 2, end + 2 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("record does not end at its length")
    payload = data[body:stop]
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    if digest and fields.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != digest.lower():
        raise Damage("payload differs from its digest")
    return fields | {"payload": payload}, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What unpacks of the gzip member that begins at a place, where the unpacking
    stopped, and why if that is not the member's end."""
    unpack, parts, view = zlib.decompressobj(wbits=31), [], memoryview(data)
    # a piece that breaks gives nothing, so it is taken again in smaller ones
    for step in (1 << 20, 1 << 12, 1):
        while at < len(data) and not unpack.eof:
            before = unpack.copy()
            try:
                parts.append(unpack.decompress(view[at : at + step]))
            except zlib.error:
                unpack = before
                break
            at = min(at + step, len(data)) - len(unpack.unused_data)
        else:
            return b"".join(parts), at, "" if unpack.eof else "gzip member is cut"
    return b"".join(parts), at, "gzip member does not unpack"


def _plain(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Walk the records of an unpacked member."""
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            fields, end = _record(data, at)
        except Damage as problem:
            if lost is None:
                lost, reason = at, str(problem)
            version = _VERSION.search(data, at + 1)
            at = version.start() if version else len(data)
            continue
        if lost is not None:
            yield "gap", lost, at, reason
            lost = None
        yield "record", at, end, fields
        at = end
    if lost is not None:
        yield "gap", lost, len(data), reason


def walk(data: bytes) -> Iterator[tuple[str, int, int, object, int | None, int | None]]:
    """Walk an archive: ("record", start, end, fields) for every valid record and
    ("gap", start, end, reason) for the bytes between, each with its range inside
    the unpacked gzip member or twice None. Plain records and gzip members may be
    mixed; a member may hold several records. What comes from a member has the
    member's range in the file. A member that breaks is a gap up to the next valid
    place; its records and the gaps between them have that range, too, and the
    gap's range inside begins behind the last of them and is open."""
    at, lost, reason, behind = 0, None, "", None
    held: list[tuple[str, int, int, object]] = []
    # records that a broken member gave, and where its unpacking stopped: stored
    # blocks hold their content as it is, so the search meets the same bytes again
    given: set[bytes] = set()
    until = 0

    def gap(end: int):
        yield from ((kind, lost, end, found, a, b) for kind, a, b, found in held)
        yield "gap", lost, end, reason, behind, None

    while at < len(data):
        why, end, found = "", at, []
        if data.startswith(_MEMBER, at):
            content, end, why = _member(data, at)
            found = list(_plain(content))
            if why:
                whole = len(found) == 1 and found[0][1:3] == (0, len(content))
                while found and found[-1][0] == "gap":
                    found.pop()
                fresh = [x for x in found if x[0] == "record" and hashlib.sha256(content[x[1] : x[2]]).digest() not in given] if at < until else found
                if fresh and not whole:
                    if lost is not None:
                        yield from gap(at)
                    lost, reason, held, behind = at, why, found, found[-1][2]
                    given = {hashlib.sha256(content[a:b]).digest() for kind, a, b, _ in found if kind == "record"}
                    until = end
        else:
            try:
                fields, end = _record(data, at)
                if at < until and hashlib.sha256(data[at:end]).digest() in given:
                    why = "record was read from its member"
            except Damage as problem:
                why = str(problem)
        if why:
            if lost is None:
                lost, reason = at, why
            version, member = _VERSION.search(data, at + 1), data.find(_MEMBER, at + 1)
            at = min([p for p in (version.start() if version else -1, member) if p >= 0], default=len(data))
            continue
        if lost is not None:
            yield from gap(at)
            lost, held, behind = None, [], None
        if data.startswith(_MEMBER, at):
            yield from ((kind, at, end, what, a, b) for kind, a, b, what in found)
        else:
            yield "record", at, end, fields, None, None
        at = end
    if lost is not None:
        yield from gap(len(data))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """The same without the ranges inside members."""
    return (found[:4] for found in walk(data))


_PAGE = re.compile(r"^<urn:page:(.*?)(?:\?row=[0-9a-f-]{36})?>$", re.S)
_ROW = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("page_id", pa.string()),
    ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("inner_start", pa.int64()), ("inner_end", pa.int64()),
])
_ROW_TYPES = (
    "kind string, path string, start long, end long, reason string, page_id string, url string, record_type string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, inner_start long, inner_end long"
)


def _row(path: str, kind: str, start: int, end: int, found, inner_start: int | None, inner_end: int | None, with_payload: bool) -> dict:
    row = {"kind": kind, "path": path, "start": start, "end": end, "inner_start": inner_start, "inner_end": inner_end}
    if kind == "gap":
        return row | {"reason": found}
    named = lambda key: (_PAGE.match(found.get(key, "")) or [None, None])[1]
    again = found.get("warc-type") == "revisit"
    payload = found["payload"]
    size = found.get("payload-length", "")
    return row | {
        "page_id": named("warc-record-id"), "url": found.get("warc-target-uri"), "record_type": found.get("warc-type"), "refers_to": named("warc-refers-to"),
        "payload_bytes": int(size) if again and size.isdigit() else len(payload),
        "payload_digest": found.get("warc-payload-digest", "").rpartition(":")[2].lower() if again else hashlib.sha256(payload).hexdigest(),
        "payload": payload if with_payload and not again else None,
    }


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every valid record (``kind`` record) and every quarantined gap (``kind``
    gap, with ``reason``) of the archives in a folder: file, byte range, page id,
    address, type, payload size and digest, the payload unless left out, and the
    range inside an unpacked gzip member. An archive file, and what a member of it
    unpacks to, must fit a task's memory; a file is at most 2 GB."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                data, made, size = content.as_py(), [], 0
                for found in walk(data):
                    made.append(_row(name.as_py(), *found, with_payload))
                    size += len(made[-1].get("payload") or b"")
                    if len(made) >= 4096 or size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(made, schema=_ROW)
                        made, size = [], 0
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=_ROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, _ROW_TYPES)


def _id(text: Column, kind: str) -> Column:
    return text.cast(kind)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read the archives back, and list every record."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read_archives(pages.sparkSession, write_archives(pages), with_payload=False).where(F.col("kind") == "record")
    return found.select(_id(F.col("page_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _id(F.col("refers_to"), kind).alias("refers_to"))
