"""WARC archives: a writer with payload de-duplication and a salvaging reader.

Writer. Every row becomes one record: a ``response`` holding HTTP headers and the payload, or, for equal
payloads, a ``revisit`` holding the HTTP headers only (their Content-Length stays that of the payload) and
a reference to the record with the largest id, which is the response. Records leave through Spark's text
sink, so archives can live in any store Spark writes: plain, with the CRLF that ends a record as the line
separator, or as one gzip member per record, with an empty member as the separator.

Reader. Archives are read as binary files, plain or with one gzip member per record. A record that fails a
check (version line, headers, length, closing CRLFs, gzip trailer, payload digest) is not trusted: the
reader searches for the next member or version line that starts a valid record, goes on from there, and
logs the bytes between as a quarantined gap with the reason. The other records of a member that holds a bad
one are kept, and so are those before the place where a member's stream breaks.

Scale: equal payloads meet by digest in a map-side combined maximum that is joined back (narrow keys,
splittable where one payload is very common); html is shuffled at most once. Archives hold at most
``FILE_RECORDS`` records of at most ``LARGE`` bytes each, or at most ``FILE_BYTES`` of larger ones (and at least one), so a
reading task has one bounded file at a time. Foreign archives are bounded by the 2 GB that a binary column holds.

Cases: null html is the empty payload; a null id is written as the word ``null`` and read back as null;
rows that repeat both id and payload are all responses; line breaks in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, new_path, remove

FILE_RECORDS = 2_000
#: Bytes of URL and payload of a record that shares its archive with few others, and of these together.
LARGE, FILE_BYTES = 32_768, 64 << 20
CHUNK = 16_384
PREFIX = "urn:siltstone:record:"
RECORDS = (
    "path string, part string, offset long, size long, record_id string, record_type string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, reason string, payload binary"
)
ARROW = pa.schema(
    [("path", pa.string()), ("part", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("record_id", pa.string()),
     ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("reason", pa.string()), ("payload", pa.binary())]
)


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id, url: str | None, payload: bytes, original, date: str) -> bytes:
    """A whole record but for its last CRLF."""
    safe = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    revisit = original is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>".encode(),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + safe,
        b"WARC-Payload-Digest: sha1:" + digest(payload).encode(),
    ]
    if revisit:
        lines.append(f"WARC-Refers-To: <{PREFIX}{original}>".encode())
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n"


def originals(pages: DataFrame, min_bytes: int) -> DataFrame:
    """id, url, payload and ``original``: the id that the row's record refers to, or null."""
    rows = pages.withColumn("__d", F.sha2("payload", 256))
    best = (
        rows.where(F.length("payload") >= min_bytes)
        .groupBy("__d")
        .agg(F.max("page_id").alias("__best"), F.count("*").alias("__n"))
        .where("__n > 1 and __best is not null")
        .select("__d", "__best")
    )
    return rows.join(best, "__d", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("__best")), F.col("__best")).alias("original")
    )


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_records: int = FILE_RECORDS, compress: bool = True,
) -> None:
    """Write ``df`` as WARC files under ``path``. Payloads of fewer than ``min_bytes`` are never revisits."""
    ending = b"\r\n"
    pages = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (record(*row, date) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if compress:
                rows = (member(r + ending) for r in rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])

    separator = member(b"").decode("latin-1") if compress else ending.decode()
    size = F.length("payload") + F.coalesce(F.octet_length("url"), F.lit(0))
    longest = pages.select(size.alias("size")).where(F.col("size") > LARGE).agg(F.max("size")).first()[0]
    # equal payloads are equally long, but their URLs may differ, so only the payload decides who meets
    rows = originals(pages, min_bytes)
    classes = [(size <= LARGE, file_records)] + ([(size > LARGE, max(1, min(file_records, FILE_BYTES // longest)))] if longest else [])
    for chosen, most in classes:
        records = rows.where(chosen).mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
        # the encoding concerns the separator only; values are written byte by byte
        records.write.mode("append").option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", most).text(path)


def member(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Invalid(ValueError):
    """Why bytes at some place are no valid record."""


#: What ends a record's headers, however long they are: an empty line, or the next record where it is missing.
HEAD_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")


def parse_record(data: bytes, at: int) -> tuple[int, dict]:
    """The record at an offset of uncompressed bytes and where the next one starts."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Invalid("no version line")
    ending = HEAD_END.search(data, at)
    if ending is None or ending[0] != b"\r\n\r\n":
        raise Invalid("headers do not end")
    head_end = ending.start()
    fields, last = {}, None
    for line in data[at:head_end].split(b"\r\n")[1:]:
        if last and line[:1] in (b" ", b"\t"):  # a folded line goes on with the value before it
            fields[last] = f"{fields[last]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Invalid("malformed header")
        last = name.strip().lower().decode("latin-1")
        fields[last] = value.strip().decode("utf-8", "replace")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Invalid("a mandatory header is missing")
    if not fields.get("content-length", "").isdigit():
        raise Invalid("no content length")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Invalid("record does not end where its length says")
    block, payload, length = data[start:end], None, None
    if "http" in fields.get("content-type", "") and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if said := re.search(rb"(?i)\ncontent-length:\s*(\d+)", http):
            length = int(said[1])
    else:
        payload = block
    kind = fields.get("warc-type", "")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        payload, found = None, declared
    else:
        length, found = len(payload), digest(payload)
        if declared and declared.upper() != found:
            raise Invalid("payload digest differs")
    clean = lambda s: s.strip("<>") or None
    return end + 4, {
        "record_id": clean(fields.get("warc-record-id", "")), "record_type": kind, "url": fields.get("warc-target-uri"),
        "refers_to": clean(fields.get("warc-refers-to", "")), "payload_bytes": length, "payload_digest": found or None, "payload": payload,
    }


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member at an offset as far as they inflate, where they end, and why there are no more, or ''."""
    stream, out, end = zlib.decompressobj(31), [], at
    while not stream.eof and end < len(data):
        try:
            # by chunks, since what follows a member comes back as a copy
            out.append(stream.decompress(data[end : end + CHUNK]))
        except zlib.error as broken:
            # a failing call gives nothing: once more, byte by byte up to the failure
            stream = zlib.decompressobj(31)
            stream.decompress(data[at:end])
            try:
                while True:
                    out.append(stream.decompress(data[end : end + 1]))
                    end += 1
            except zlib.error:
                return b"".join(out), end, f"gzip: {broken}"
        end += CHUNK
    end = min(end, len(data)) - len(stream.unused_data)
    return b"".join(out), end, "" if stream.eof else "gzip member is cut off"


def parse_member(data: bytes, at: int) -> tuple[int, list[dict], str]:
    """The gzip member at an offset: where it ends, the records and gaps it holds, and what is wrong with the stream, or ''.

    Where only the trailer is wrong and every record looks right, nothing tells which one is not, so none is trusted.
    """
    if data[at : at + 3] != b"\x1f\x8b\x08":
        raise Invalid("no gzip member")
    plain, end, broken = inflate(data, at)
    found = list(salvage(plain, VERSION))
    gaps = [one for one in found if one["part"] == "gap"]
    if found and len(gaps) == len(found) or broken and (not found or re.search("incorrect (data|length) check", broken) and not gaps):
        raise Invalid(broken or gaps[0]["reason"])
    return end, found, broken


#: Starts that a search tries: a version line, or a member's magic number. Only whole valid records count.
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def salvage(data: bytes, starts: re.Pattern = START) -> Iterator[dict]:
    """Records of an archive in order, and a ``gap`` for every stretch of bytes that is in none of them.

    Records and gaps of a gzip member have the member's offset and size. A member whose stream is broken is a gap,
    after the records that its beginning holds.
    """
    at, gap, reason = 0, None, ""
    rescued: list[dict] = []  # of the last broken member, which ends at ``until``
    until = 0
    while at < len(data):
        try:
            if starts is START and data[at : at + 2] == b"\x1f\x8b":
                end, found, broken = parse_member(data, at)
                if broken:
                    rescued, until = [{**one, "offset": at, "size": end - at} for one in found if one["part"] == "record"], end
                    if gap is not None:
                        yield {"part": "gap", "offset": gap, "size": at - gap, "reason": reason}
                        gap = None
                    yield from rescued
                    raise Invalid(broken)
            else:
                end, one = parse_record(data, at)
                if at < until and any(one.items() <= other.items() for other in rescued):
                    raise Invalid("part of a broken gzip member")  # stored there without compression
                found = [{"part": "record", **one}]
        except Invalid as why:
            if gap is None:
                gap, reason = at, str(why)
            following = starts.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield {"part": "gap", "offset": gap, "size": at - gap, "reason": reason}
            gap = None
        for one in found:
            yield {**one, "offset": at, "size": end - at}
        at = end
    if gap is not None:
        yield {"part": "gap", "offset": gap, "size": len(data) - gap, "reason": reason}


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record or gap of every archive under ``path``; ``payloads=False`` leaves payloads null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for row in salvage(batch.column(1)[i].as_py()):
                    if not payloads:
                        row.pop("payload", None)
                    rows.append({"path": name, **row})
                    held += row.get("payload_bytes") or 0 if payloads else 0
                    if len(rows) >= 5_000 or held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.mapInArrow(parse, RECORDS)


def archive_round_trip(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html), read the archives back: one row per page's record. The archives are removed."""
    path = new_path(df.sparkSession, "warc")
    write_archives(df, path, min_bytes=min_bytes)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) as bigint)")
    read = read_archives(df.sparkSession, path, payloads=False).where("part = 'record'")
    digests = read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url"
    )
    kept = Scratch(df.sparkSession, "warc").save(digests, "read")
    remove(df.sparkSession, path)
    return kept
