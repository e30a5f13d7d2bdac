"""WARC: archives of gzip members with revisit records, and a salvage reader.

The writer deals records to archives of bounded size, one gzip member each, and stores the archives as
rows (archive, content) of a table in the shared folder. Of the records with equal payloads the one with
the largest page_id is the response; the others are revisits that refer to it and store no payload.

The reader checks every record: the member's own checks, the version line, the headers, all lengths, the
block's digest. A member may hold several records; one that expands to more than ``MEMBER_BYTES`` is read in pieces
twice, first to check it and then for its records, and of it no more is held than a header line, a piece, or a payload
that the caller asks for. After a failed check it looks for the next place where a whole valid member or record
begins, goes on from there, and reports the bytes between as a gap with the reason.

Defined results: null html is an empty payload; a null url has no target line; repeated rows with the
largest page_id are all responses; null page_ids are smaller than all others; urls and texts of any length that a row can
hold are written and come back; an empty table gives no archives and no rows. Extra columns are ignored. An archive is one
value of a row, so a task holds a whole one (8 MB, or one record that is longer) and a few copies of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

ARCHIVE_BYTES = 8 << 20
BROADCAST_GROUPS = 200_000  # about 30 bytes each
MEMBER_BYTES = 64 << 20  # a gzip member that expands to more is read in pieces
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "archive string, kind string, offset long, length long, reason string, record_type string, record_id string, refers_to string, target string, payload_length long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member, equal for equal input."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}"] if url is not None else ()), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else ()), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, limit: int = ARCHIVE_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(archive, content) of pages (page_id, url, html), stored in the shared folder.

    The html stays where it is: the groups of equal payloads are broadcast, the largest ``broadcast_groups``
    of them if there are more. Only records of the smaller groups beyond are then joined by payload hash,
    so that no group of equal payloads meets in one task unless it is small.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.unhex(F.sha1("html")))
    groups = written(rows.groupBy("h").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1"), "groups")
    many = groups.count() > broadcast_groups
    largest = groups.orderBy(F.desc("n"), "h").limit(broadcast_groups) if many else groups
    marked = rows.join(F.broadcast(largest.select("h", "last", F.lit(True).alias("known"))), "h", "left")
    if many:
        rest = groups.join(F.broadcast(largest.select("h")), "h", "left_anti").select("h", "last")
        marked = marked.filter("known").drop("known").unionByName(marked.filter("known is null").drop("known", "last").join(rest, "h", "left").select("h", "page_id", "url", "html", "last"))
    marked = marked.select("page_id", "url", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to"), "html")

    def run(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for part in small(batch, "html"):
                for page_id, url, refers_to, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append(record(page_id, url, html.encode(), refers_to))
                    size += len(held[-1])
                    if size >= limit:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)])], names=["archive", "content"])
                        n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)])], names=["archive", "content"])

    return written(marked.mapInArrow(run, "archive string, content binary"), "archives")


class Bad(ValueError):
    """A failed check."""


def number(text: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", text):
        raise Bad("a length is no number")
    return int(text)


def add_header(headers: dict[str, str], line: bytes) -> None:
    name, colon, value = line.partition(b":")
    if not colon:
        raise Bad("a header without colon")
    headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()


def block_length(headers: dict[str, str]) -> int:
    if "content-length" not in headers or "warc-type" not in headers:
        raise Bad("no type or length")
    number(headers.get("warc-payload-length", "0"))
    return number(headers["content-length"])


def is_http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").startswith("application/http")


class Measured(NamedTuple):
    """The payload of a block that was read in pieces; its bytes only if they were asked for."""

    length: int
    digest: str
    payload: bytes | None


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that begins at a place."""
    if not (m := _VERSION.match(data, at)):
        raise Bad("no version line")
    headers, line_at = {}, m.end()
    while (to := data.find(b"\r\n", line_at)) != line_at:
        if to < 0:
            raise Bad("headers don't end")
        add_header(headers, data[line_at:to])
        line_at = to + 2
    begin = line_at + 2
    to = begin + block_length(headers)
    if to > len(data) or data[to : to + 4] != b"\r\n\r\n":
        raise Bad("the block's length is wrong")
    block = data[begin:to]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise Bad("the block's digest is wrong")
    return headers, block, to + 4


TOO_LARGE = "the member is too large"


def member(data: bytes, at: int, most: int) -> tuple[bytes, int, str]:
    """(what it holds, end, '') of the gzip member at a place; of a damaged one what came before the damage, and the reason."""
    for step in (1 << 16, 1 << 8):  # small steps get nearer to the damage
        stream, plain, size, to, reason = zlib.decompressobj(31), [], 0, at, ""
        try:
            while not stream.eof and to < len(data) and size <= most:
                plain.append(stream.decompress(data[to : to + step], most + 1 - size))
                while stream.unconsumed_tail and size + len(plain[-1]) <= most:
                    size += len(plain[-1])
                    plain.append(stream.decompress(stream.unconsumed_tail, most + 1 - size))
                size += len(plain[-1])
                to += step
        except zlib.error:
            reason = "the member is damaged"
        if not reason:
            reason = TOO_LARGE if size > most else "" if stream.eof else "the member is cut off"
            break
    return b"".join(plain), min(to, len(data)) - len(stream.unused_data), reason


def plain_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(offset, end, headers, block, '') of the records of uncompressed bytes, (offset, end, None, b'', reason) of gaps."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = parse(data, at)
            yield at, end, headers, block, ""
        except Bad as e:
            end = next((m.start() for m in _VERSION.finditer(data, at + 1) if valid(data, m.start())), len(data))
            yield at, end, None, b"", str(e)
        at = end


def valid(data: bytes, at: int) -> bool:
    try:
        return bool(parse(data, at))
    except Bad:
        return False


class Expanded:
    """What a gzip member expands to, of which a run of bytes is held. Places count from the member's first byte."""

    def __init__(self, data: bytes, at: int):
        self.data, self.to, self.raw, self.stream = data, at, b"", zlib.decompressobj(31)
        self.held, self.start, self.reason = bytearray(), 0, ""

    def more(self) -> bool:
        """Holds another piece; False at the end, or at damage, which is met byte by byte."""
        size = 1 << 16
        while not self.stream.eof and not self.reason:
            if not self.raw:
                self.raw = self.data[self.to : self.to + size]
                self.to += len(self.raw)
            if not self.raw:  # the stream may still hold some of its output
                if rest := self.stream.decompress(b"", PIECE):
                    self.held += rest
                    return True
                self.reason = "the member is cut off"
                break
            before, step = self.stream.copy(), self.raw[:size]
            try:
                piece = self.stream.decompress(step, PIECE)
            except zlib.error:
                self.stream, size = before, size >> 8
                if not size:
                    self.reason = "the member is damaged"
                continue
            self.raw = self.raw[len(step) - len(self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail) :]
            if piece:
                self.held += piece
                return True
        return False

    def fill(self, to: int) -> bool:
        """Holds what comes before a place; False if there is not so much."""
        while self.start + len(self.held) < to:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, at: int, forget: bool = False) -> int:
        """Where a mark comes next, -1 if it doesn't; what it passes may be forgotten."""
        while (k := self.held.find(mark, at - self.start)) < 0:
            at = max(at, self.start + len(self.held) - len(mark) + 1)
            if forget:
                self.forget(at)
            if not self.more():
                return -1
        return self.start + k

    def forget(self, to: int) -> None:
        del self.held[: to - self.start]
        self.start = to

    def mark(self) -> tuple:
        return self.to, self.raw, self.stream.copy(), bytes(self.held), self.start, self.reason

    def back(self, mark: tuple) -> None:
        self.to, self.raw, stream, held, self.start, self.reason = mark
        self.stream, self.held = stream.copy(), bytearray(held)


def parse_pieces(x: Expanded, at: int, keep: bool) -> tuple[dict[str, str], Measured, int]:
    """(headers, payload, end) of the record at a place of what a member expands to; the block is read and hashed in pieces."""
    if not x.fill(at + 10) or not _VERSION.match(x.held, at - x.start):
        raise Bad("no version line")
    headers, line_at = {}, at + 10
    while (to := x.find(b"\r\n", line_at)) != line_at:
        if to < 0:
            raise Bad("headers don't end")
        add_header(headers, bytes(x.held[line_at - x.start : to - x.start]))
        line_at = to + 2
    at, to = line_at + 2, line_at + 2 + block_length(headers)
    whole, own, length, kept = hashlib.sha1(), hashlib.sha1(), 0, []
    head = b"" if is_http(headers) else None  # the end of what was read before the payload
    while at < to:
        if not x.fill(at + 1):
            raise Bad("the block's length is wrong")
        x.forget(at)
        piece = bytes(x.held[: to - at])
        at += len(piece)
        whole.update(piece)
        if head is not None:
            before, blank, piece = (head + piece).partition(b"\r\n\r\n")
            head = None if blank else before[-3:]
        own.update(piece)
        length += len(piece)
        if keep:
            kept.append(piece)
    if not x.fill(to + 4) or x.held[to - x.start : to - x.start + 4] != b"\r\n\r\n":
        raise Bad("the block's length is wrong")
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base64.b32encode(whole.digest()).decode():
        raise Bad("the block's digest is wrong")
    return headers, Measured(length, base64.b32encode(own.digest()).decode(), b"".join(kept) if keep else None), to + 4


Item = tuple[dict[str, str] | None, "bytes | Measured", str]


def member_in_pieces(x: Expanded, keep: bool) -> Iterator[Item]:
    """(headers, payload, '') of the records of a member and (None, b'', reason) of gaps between them, as ``plain_records``."""
    at = 0
    while x.fill(at + 1):
        x.forget(at)
        here = x.mark()
        try:
            headers, block, at = parse_pieces(x, at, keep)
            yield headers, block, ""
            continue
        except Bad as e:
            why = str(e)
        x.back(here)
        while (at := x.find(b"WARC/1.", at + 1, forget=True)) >= 0:
            x.forget(at)
            here = x.mark()
            try:
                parse_pieces(x, at, False)
                x.back(here)
                break
            except Bad:
                x.back(here)
        yield None, b"", why
        if at < 0:
            return


def large_member(data: bytes, at: int, keep: bool) -> tuple[Iterable[Item], bool, int, str]:
    """As ``records_at``, for a member of any size: read once to check it, and again as its records are taken."""
    x = Expanded(data, at)
    first, some, sure = "an empty member", False, False
    for k, (headers, _, why) in enumerate(member_in_pieces(x, False)):
        first = why if k == 0 else first
        some, sure = some or headers is not None, sure or digested(headers)
    while x.more():
        x.forget(x.start + len(x.held))
    if x.reason:
        return (i for i in member_in_pieces(Expanded(data, at), keep) if digested(i[0])), sure, at, x.reason
    return (member_in_pieces(Expanded(data, at), keep), True, x.to - len(x.raw), "") if some else ([], False, at, first)


def digested(headers: dict[str, str] | None) -> bool:
    return headers is not None and headers.get("warc-block-digest", "").startswith("sha1:")


def records_at(data: bytes, at: int, keep: bool = True) -> tuple[Iterable[Item], bool, int, str]:
    """(records and gaps, whether there is a record, end, '') of what begins at a place: a plain record, or a gzip member with all it holds.

    With a reason, nothing whole begins there; of a damaged member, the records whose digest is right come still.
    """
    if data[at : at + 2] != b"\x1f\x8b":
        try:
            headers, block, end = parse(data, at)
        except Bad as e:
            return [], False, at, str(e)
        return [(headers, block, "")], True, end, ""
    plain, end, reason = member(data, at, MEMBER_BYTES)
    if reason == TOO_LARGE:
        del plain
        return large_member(data, at, keep)
    found = [(h, block, why) for _, _, h, block, why in plain_records(plain)]
    if reason:
        found = [x for x in found if digested(x[0])]
        return found, bool(found), at, reason
    if not any(h for h, *_ in found):
        return [], False, at, found[0][2] if found else "an empty member"
    return found, True, end, ""


def salvage(data: bytes, keep: bool = True) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | Measured, str]]:
    """(offset, end, headers, block, '') of valid records and (offset, end, None, b'', reason) of gaps, in order.

    Records and gaps inside one gzip member have the offset and end of the member. Records before the
    damage in a damaged member, if their digest is right, have those of the gap that follows them. Of members read in
    pieces the payload stands for the block, its bytes only with ``keep``.
    """
    at = 0
    while at < len(data):
        found, _, end, reason = records_at(data, at, keep)
        if reason:
            end = next((m.start() for m in _START.finditer(data, at + 1) if records_at(data, m.start(), False)[1]), len(data))
        for headers, block, why in found:
            yield at, end, headers, block, why
        if reason:
            yield at, end, None, b"", reason
        at = end


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of RECORDS: kind ``record`` for each valid record, ``gap`` for each run of quarantined bytes. payload_length and payload_digest are of the stored payload, or as stated where a revisit stores none."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, end, h, block, reason in salvage(content.as_py() or b"", payloads):
                    if h is None:
                        rows.append((archive, "gap", at, end - at, reason, *[None] * 7))
                        continue
                    if not isinstance(block, Measured):
                        block = block.partition(b"\r\n\r\n")[2] if is_http(h) else block
                        block = Measured(len(block), digest(block), block)
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if h["warc-type"] == "revisit":
                        length, found = number(h.get("warc-payload-length", "0")), stated
                    else:
                        length, found = block.length, block.digest
                    strip = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x is not None else None
                    rows.append((archive, "record", at, end - at, "", h["warc-type"], strip(h.get("warc-record-id")), strip(h.get("warc-refers-to")), h.get("warc-target-uri"), length, found, block.payload if payloads else None))
                    if len(rows) >= 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return archives.select("archive", "content").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    kinds = (s, s, n, n, s, s, s, s, s, n, s, pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False).filter("kind = 'record'")
    return found.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))
