"""Web archives: a writer with revisit records and a salvage reader.

Archives are rows (archive, content) of bounded size, each content a sequence
of gzip members with one WARC/1.1 record each. Any binary table works as input
of the reader, for instance ``spark.read.format("binaryFile")`` over real
.warc or .warc.gz files.

The reader checks each record: gzip checksum, version line, content length,
record end, block digest, payload digest. After a failed check it searches for
the next place where a whole valid record starts (a gzip member or a version
line), goes on there, and logs the bytes between as a quarantined gap. A member
may hold many records; of a member that is cut off the whole ones are kept. A
member that fails its gzip checksum is quarantined whole: nothing tells which
of its bytes are right.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

GROUP_BYTES, GROUP_RECORDS = 4_000_000, 10_000       # records handed on at once
ARCHIVE_BYTES = 4_000_000
MIN_REVISIT_BYTES = 100
# The profile of revisit records, and the record's version line.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
GZIP = b"\x1f\x8b\x08"
GZIP_STEP = 32_768
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
PAGE_ID = re.compile(r"<urn:page:(.*)>")


def block_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1(block).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the length of the
    payload, and not the payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    if kind == "response":
        block += payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: {block_digest(block)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows (archive, n_records, content) holding one record per page.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is a response and the others revisit it. Null html counts
    as empty; null urls as empty; rows that repeat the smallest id are all
    responses; a null id is larger than any other, and a payload held by null
    ids only has responses only. Other columns are not archived. An empty
    table gives no archive. An archive ends once it holds ARCHIVE_BYTES.
    """
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"),
                        F.sha2(html, 256).alias("digest"))
    firsts = stage(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
                   .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
                   .select(F.col("digest").alias("f_digest"), "first_id"), "payloads", slim=True)
    planned = rows.join(firsts, F.col("digest") == F.col("f_digest"), "left").select(
        "id", "url", "payload", "digest",
        F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("id")), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{n:06d}.warc.gz"], "n_records": [len(held)],
                                               "content": [b"".join(held)]})
        for batch in batches:
            cols = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for values in zip(*cols):
                i, url, payload, digest, refers = (v.as_py() for v in values)
                held.append(gzip_member(record("response" if refers is None else "revisit", i, url, payload, digest, refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, n = [], 0, n + 1
        if held:
            yield archive()
    return planned.mapInArrow(run, "archive string, n_records long, content binary")


def agrees(given: str, name: str, raw: bytes) -> bool:
    """Whether a labelled digest in hex, base32 or base64 is ``raw``. Digests
    of other algorithms than ``name`` are not checked."""
    label, _, value = given.partition(":")
    if label.strip().lower().replace("-", "") != name:
        return True
    value = value.strip().rstrip("=")
    return (value.lower() in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())
            or value in (f(raw).decode().rstrip("=") for f in (base64.b64encode, base64.urlsafe_b64encode)))


class Damaged(Exception):
    """A check failed; the message says which."""


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    if not VERSION_LINE.match(data, at):
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header end")
    head = {}
    for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdecimal():
        raise Damaged("content length")
    stop = end + 4 + int(head["content-length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Damaged("record end")
    block = data[end + 4:stop]
    if "warc-block-digest" in head and not agrees(head["warc-block-digest"], "sha1", sha1(block).digest()):
        raise Damaged("block digest")
    return head, block, stop + 4


def gunzip(content: bytes, at: int, stop: int) -> tuple[bytes, int | None]:
    """The data of the gzip member at ``at`` and the member's end, None if it
    does not end before ``stop``; fed step by step so that no more than a step
    is copied behind the member."""
    member, out = zlib.decompressobj(31), []
    try:
        while not member.eof and at < stop:
            step = content[at:min(at + GZIP_STEP, stop)]
            out.append(member.decompress(step))
            at += len(step)
    except zlib.error as e:
        raise Damaged("gzip member") from e
    return b"".join(out), at - len(member.unused_data) if member.eof else None


def described(head: dict[str, str], block: bytes) -> dict:
    """The fields of a good record; checks the payload digest."""
    kind = head.get("warc-type", "")
    http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    digest, payload, size = sha256(body).hexdigest(), body, len(body)
    given = head.get("warc-payload-digest", "")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        digest, payload, size = given.removeprefix("sha256:"), None, int(length[1]) if length else None
    elif not agrees(given, "sha256", bytes.fromhex(digest)):
        raise Damaged("payload digest")
    page, refers = PAGE_ID.fullmatch(head.get("warc-record-id", "")), PAGE_ID.fullmatch(head.get("warc-refers-to", ""))
    return {"record_type": kind, "record_id": page[1] if page else head.get("warc-record-id"),
            "target_uri": head.get("warc-target-uri"), "payload": payload, "payload_bytes": size, "payload_digest": digest,
            "refers_to": refers[1] if refers else None}


def inside(data: bytes) -> Iterator[dict | str]:
    """Fields of the good records in a member's data, and the reasons of the
    gaps between them with their place in the data."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            head, block, end = parse(data, at)
            fields = described(head, block)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            nxt = VERSION_LINE.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if gap is not None:
            yield f"{reason} (bytes {gap} to {at} of the member's data)"
            gap = None
        yield fields
        at = end
    if gap is not None:
        yield f"{reason} (bytes {gap} to {at} of the member's data)"


def take(content: bytes, at: int) -> tuple[list[dict | str], int]:
    """What the plain record or gzip member at ``at`` holds, and its end."""
    if not content.startswith(GZIP, at):
        head, block, end = parse(content, at)
        return [described(head, block)], end
    data, end = gunzip(content, at, len(content))
    if end is None:
        raise Damaged("gzip member cut off")
    found = list(inside(data))
    if not any(isinstance(f, dict) for f in found):
        raise Damaged(found[0].partition(" (")[0] if found else "version line")
    return found, end


def rescued(content: bytes, starts: list[int], stop: int) -> Iterator[tuple[int, int, dict]]:
    """Whole records of members that begin in a gap and are cut off at its
    end. Their bytes are the gap's, so their length is 0."""
    for at in starts:
        try:
            data, end = gunzip(content, at, stop)
        except Damaged:
            continue
        if end is None:
            yield from ((at, 0, f) for f in inside(data) if isinstance(f, dict))


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(offset, length, fields) of good records and (offset, length, reason) of
    quarantined gaps; together they cover the whole content. What shares a
    gzip member has its offset; the first has its length and the others 0."""
    at, gap, reason = 0, None, ""
    starts: list[int] = []
    while at < len(content):
        try:
            found, end = take(content, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            if content.startswith(GZIP, at):
                starts.append(at)
            nxt = START.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        if gap is not None:
            yield gap, at - gap, reason
            yield from rescued(content, starts, at)
            gap, starts = None, []
        yield at, end - at, found[0]
        yield from ((at, 0, f) for f in found[1:])
        at = end
    if gap is not None:
        yield gap, len(content) - gap, reason
        yield from rescued(content, starts, len(content))


FIELDS = ["record_type", "record_id", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to"]


def read_archives(archives: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """One row per record or gap: archive, byte_offset, byte_length,
    record_type, record_id, target_uri, payload (null for revisits),
    payload_bytes, payload_digest, refers_to, and for gaps record_type "gap"
    and the failed check in gap_reason. Rows of one gzip member share its
    offset; the first has its length, the others 0. A null or empty content gives no row;
    other columns of ``archives`` are not carried; rows are independent. Records
    are handed on in groups of about GROUP_BYTES, so besides the archive itself
    and one inflated member no more is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()),
                            ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.string()), ("gap_reason", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                out, held = [], 0
                for offset, length, what in salvage(content.as_py() or b""):
                    row = {"archive": name.as_py(), "byte_offset": offset, "byte_length": length}
                    out.append(row | ({"record_type": "gap", "gap_reason": what} if isinstance(what, str) else what))
                    held += len(out[-1].get("payload") or b"")
                    if held >= GROUP_BYTES or len(out) >= GROUP_RECORDS:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
    return archives.select(F.col(name_col).alias("name"), F.col(content_col).alias("content")).mapInArrow(
        run, "archive string, byte_offset long, byte_length long, record_type string, record_id string, target_uri string, "
             "payload binary, payload_bytes long, payload_digest string, refers_to string, gap_reason string")
