r"""WARC archives of web pages: written in segments, read back and reassembled.

Writer: every page becomes a record with a digest of its payload. Of pages with equal payloads one is a
response and the others revisit it. Blocks longer than a segment continue in continuation records, which name
the first record, their number and, on the last one, the total length. Payloads stand in HTTP messages with
chunked transfer framing, so segments cut through chunks.

Reader: records are found by their Content-Length. Continuations are grouped by origin, ordered by number,
checked against the total length, and the chunked framing is decoded.

Files are Spark text output whose "lines" are whole records: a record ends with two line breaks, of which the
line separator is the second. A file holds a bounded number of bounded records, so one file is read as one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardmap.llm.arrays import small_batches
from wardmap.llm.keys import type_of
from wardmap.session import new_path, stored

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 16 << 10
RECORDS_PER_FILE = 1000
#: Payloads of at least so many bytes are written once and revisited.
LEAST_REVISITED = 0

# Names and values of the WARC 1.1 and HTTP 1.1 formats.
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_SAME = b"HTTP/1.1 304 Not Modified\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = b"2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing; chunks end between characters."""
    out, start = [], 0
    while start < len(payload):
        stop = whole_characters(payload, start, size)
        out += [b"%x\r\n" % (stop - start), payload[start:stop], b"\r\n"]
        start = stop
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(message: bytes) -> bytes | None:
    """The payload of an HTTP message; None if the framing is broken."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        return None
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while True:
        line_end = body.find(b"\r\n", at)
        size = body[at:line_end].split(b";")[0].strip() if line_end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        length, at = int(size, 16), line_end + 2
        if not length:
            return b"".join(out)
        if body[at + length:at + length + 2] != b"\r\n":
            return None
        out.append(body[at:at + length])
        at += length + 2


def whole_characters(data: bytes, start: int, size: int) -> int:
    """End of a piece of at most ``size`` bytes that does not cut a UTF-8 character."""
    stop = min(len(data), start + max(4, size))
    while stop < len(data) and stop > start + 1 and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return stop


def record(kind: bytes, record_id: bytes, block: bytes, *fields: tuple[bytes, bytes]) -> bytes:
    """A record up to the first of its two closing line breaks."""
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: <" + record_id + b">", b"WARC-Date: " + EPOCH,
             b"Content-Length: %d" % len(block)]
    if kind != b"continuation":
        lines.append(b"Content-Type: application/http; msgtype=response")
    lines += [name + b": " + value for name, value in fields]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n"


def page_records(page: bytes, url: bytes, payload: bytes, signature: bytes, first: bytes | None,
                 segment: int) -> Iterator[bytes]:
    """The records of one page; ``first`` is the id of the response that it revisits."""
    fields = [(b"WARC-Target-URI", url), (b"WARC-Payload-Digest", b"sha1:" + signature)]
    if first is not None:
        yield record(b"revisit", page, HTTP_SAME, *fields, (b"WARC-Profile", REVISIT_PROFILE),
                     (b"WARC-Refers-To", b"<" + first + b">"))
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment:
        yield record(b"response", page, block, *fields)
        return
    start, number = 0, 0
    while start < len(block):
        stop = whole_characters(block, start, segment)
        number += 1
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if stop == len(block) else []
        if number == 1:
            yield record(b"response", page, block[:stop], *fields, (b"WARC-Segment-Number", b"1"))
        else:
            yield record(b"continuation", page + b":%d" % number, block[start:stop],
                         (b"WARC-Segment-Origin-ID", b"<" + page + b">"),
                         (b"WARC-Segment-Number", b"%d" % number), *last)
        start = stop


def write_archives(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    segment: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, least: int = LEAST_REVISITED,
) -> None:
    """Write a record per page row, gzipped, to files in ``path``.

    A null html is an empty payload, a null url an empty address. Of equal payloads of at least ``least``
    bytes the row with the largest id is the response (null ids last, any one of repeated rows); the others
    revisit it. Records are named after page id and a row number, which tells repeated rows apart. Line breaks
    in urls are written as %0A and %0D. Only ids and digests are grouped and joined; the common payload of a
    large group is never gathered.
    """
    rows = pages.select(
        pages[id_column].alias("page"), F.coalesce(pages[url_column], F.lit("")).alias("url"),
        F.coalesce(pages[html_column], F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"signature": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "payloads")
    # The largest id and then the largest row number.
    last = F.max(F.struct(F.col("page").isNotNull().alias("named"), "page", "row")).alias("first")
    first = rows.where(F.col("bytes") >= least).groupBy("signature").agg(
        last, F.count("*").alias("copies")).where("copies > 1")
    # Written, so that Spark knows its size and need not move the payloads where few pages have copies.
    first = stored(first.drop("copies"), "copied")
    linked = rows.join(first, "signature", "left")

    def build(batches):
        for batch in (small for whole in batches for small in small_batches(whole)):
            out = []
            for page in batch.to_pylist():
                name = page_name(page["page"], page["row"])
                original = page["first"] and page_name(page["first"]["page"], page["first"]["row"])
                url = page["url"].replace("\r", "%0D").replace("\n", "%0A").encode()
                out += page_records(name, url, page["payload"], digest(page["payload"]).encode(),
                                    None if original in (None, name) else original, segment)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out).cast(pa.string())})
                    out = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary()).cast(pa.string())})

    linked.select("page", "row", "url", "payload", "first").mapInArrow(build, "value string").write.options(
        lineSep="\r\n", compression="gzip", maxRecordsPerFile=records_per_file).text(path)


def page_name(page: object, row: int) -> bytes:
    """The record's name: the id in percent-encoding (nothing for null, ``%`` for an empty text) and the row number."""
    text = "" if page is None else quote(str(page), safe="") or "%"
    return f"urn:page:{text}:{row}".encode()


def split_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records of a file, gzipped as a whole, by record or not at all.

    The file is unpacked piece by piece; a piece that is cut short ends the file.
    """
    buffer = bytearray()

    def pieces():
        if archive[:2] != b"\x1f\x8b":
            yield archive
            return
        rest = archive
        while rest[:2] == b"\x1f\x8b":
            unpack = zlib.decompressobj(31)
            data = rest
            while data and not unpack.eof:
                yield unpack.decompress(data, 1 << 20)
                data = unpack.unconsumed_tail
            rest = unpack.unused_data

    source = pieces()

    def need(test) -> bool:
        while not test():
            more = next(source, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while True:
        while need(lambda: len(buffer) >= 2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        if not need(lambda: b"\r\n\r\n" in buffer):
            return
        head, _, _ = bytes(buffer).partition(b"\r\n\r\n") if len(buffer) < 4096 else (
            bytes(buffer[:buffer.index(b"\r\n\r\n")]), b"", b"")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            return
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        length = int(fields.get("content-length", "0"))
        start = len(head) + 4
        if not need(lambda: len(buffer) >= start + length):  # noqa: B023
            return
        yield fields, bytes(buffer[start:start + length])
        del buffer[:start + length]


RECORDS = ("record_id string, kind string, url string, refers_to string, signature string, origin string, "
           "number bigint, total bigint, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under a path, one row each."""

    def parse(batches):
        bare = lambda x: x.strip("<>") if x else None
        number = lambda x: int(x) if x and x.isdigit() else None
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, block in split_records(content.as_py()):
                    own = bare(f.get("warc-record-id"))
                    segment = number(f.get("warc-segment-number"))
                    rows.append((own, f.get("warc-type"), f.get("warc-target-uri"), bare(f.get("warc-refers-to")),
                                 (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                                 bare(f.get("warc-segment-origin-id")) or (own if segment else None), segment,
                                 number(f.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, kind, url, refers_to, signature, message and complete.

    Only segmented records are grouped, each group being one message. A message is complete if its segments
    are numbered 1, 2, ... without gap and its length is the total that the last one states; a repeated segment
    counts once. An incomplete message is kept with what follows segment 1 without a gap.
    """
    columns = ["record_id", "kind", "url", "refers_to", "signature"]
    whole = records.where("origin is null").select(*columns, F.col("block").alias("message"),
                                                   F.lit(True).alias("complete"))
    head = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    parts = records.where("origin is not null").groupBy("origin").agg(
        *[head(c) for c in columns[1:]], F.max("total").alias("total"),
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"))
    parts = parts.withColumn("run", F.expr("filter(parts, (p, i) -> p.number = i + 1)"))
    joined = F.aggregate("run", F.lit(b""), lambda all_, p: F.concat(all_, p["block"]))
    parts = parts.withColumn("message", joined)
    return whole.unionByName(parts.select(
        F.col("origin").alias("record_id"), *columns[1:], "message",
        (F.coalesce(F.octet_length("message") == F.col("total"), F.lit(False))
         & (F.size("run") == F.size("parts"))).alias("complete")))


def pages_from(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per page: page_id, of ``id_type`` (null for records that are not named after a page), url, record_type, payload (null for revisits), digest and refers_to.

    ``payload`` is also null where a message is incomplete or its framing broken; ``valid`` tells whether the
    payload has the digest that the record states.
    """

    def decode(batches):
        for batch in (small for whole in batches for small in small_batches(whole)):
            payloads, bytes_, digests, valid = [], [], [], []
            for message, kind, complete, stated in zip(
                    batch.column("message").to_pylist(), batch.column("kind").to_pylist(),
                    batch.column("complete").to_pylist(), batch.column("signature").to_pylist(), strict=True):
                payload = unchunked(message) if kind != "revisit" and complete else None
                payloads.append(payload)
                bytes_.append(None if payload is None else len(payload))
                digests.append(stated if payload is None else digest(payload))
                valid.append(kind == "revisit" or (payload is not None and digests[-1] == stated))
            kept = batch.select(["record_id", "kind", "url", "refers_to"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(payloads, pa.binary()), pa.array(bytes_, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(valid, pa.bool_())],
                [*kept.schema.names, "payload", "payload_bytes", "payload_digest", "valid"])

    pages = records.mapInArrow(
        decode, "record_id string, kind string, url string, refers_to string, payload binary, payload_bytes bigint, "
                "payload_digest string, valid boolean")
    named = lambda c: F.regexp_extract(c, "^urn:page:([^:]*):[0-9]+$", 1)
    page = lambda c: F.when(named(c) == "%", "").when(
        named(c) != "", F.try_url_decode(named(c))).try_cast(id_type)
    return pages.select(
        page("record_id").alias("page_id"), "record_id", "url", F.col("kind").alias("record_type"),
        page("refers_to").alias("refers_to"), F.col("refers_to").alias("refers_to_record"), "payload",
        "payload_bytes", "payload_digest", "valid")


def archive_report(pages: DataFrame, **options) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the length and digest of the response it names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    id_type = type_of(pages, options.get("id_column", "page_id"))
    write_archives(pages, path, **options)
    found = stored(pages_from(reassembled(read_records(spark, path)), id_type).drop("payload", "url"), "archived")
    responses = found.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    originals = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), "payload_bytes", "payload_digest")
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(
        originals, "refers_to_record", "left")
    return responses.unionByName(revisits.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
