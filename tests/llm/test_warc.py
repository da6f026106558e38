import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from wardmap.llm.warc import (
    archive_report,
    chunked,
    pages_from,
    read_records,
    reassembled,
    record,
    split_records,
    unchunked,
    write_archives,
)

LONG = "<p>" + "ünï¢ode 日本語 text " * 400 + "</p>"
PAGES = [(1, "u1", LONG), (2, "u2", None), (3, "u3", ""), (4, None, "<b>WARC/1.1\r\n\r\nWARC-Type: response\r\n</b>"),
         (5, "u5", LONG), (5, "u5", LONG), (6, "a\r\nb", "same"), (7, "u7", "same"), (None, "n", "same"), (8, "u8", "0\r\n\r\n"),
         (9, "u9", "\n"), (10, "u10", "x" * 100_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "z") for r in rows],
                                 "page_id long, url string, html string, bytes int, signature string")


def expected(rows, least=0):
    out = []
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    for html, ids in groups.items():
        payload = html.encode()
        ids = sorted(ids, key=lambda p: (p is not None, p))
        for i, page in enumerate(ids):
            last = i == len(ids) - 1 or len(payload) < least
            out.append((page, len(payload), hashlib.sha1(payload).digest(), "response" if last else "revisit",
                        None if last else ids[-1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"segment": 50}, {"segment": 1000, "records_per_file": 2}, {"least": 5}])
def test_report_equals_brute_force(spark, options):
    import base64

    found = archive_report(pages(spark), **options).collect()
    got = [(r.page_id, r.payload_bytes, base64.b32decode(r.payload_digest), r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == expected(PAGES, options.get("least", 0))


def test_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(pages(spark), path, segment=777)
    records = read_records(spark, path)
    assert records.where("kind = 'continuation'").count() > 100
    found = pages_from(reassembled(records)).where("record_type = 'response'").collect()
    assert all(r.valid for r in found)
    assert {bytes(r.payload).decode() for r in found} == {h or "" for _, _, h in PAGES}


def test_damaged_archives(spark, tmp_path):
    path = str(tmp_path / "a")
    write_archives(pages(spark, PAGES[:1]), path, segment=1000)
    records = read_records(spark, path)
    n = records.count()
    assert n > 3
    lost = pages_from(reassembled(records.where("coalesce(number, 0) <> 2"))).first()
    assert not lost.valid and lost.payload is None
    tail = pages_from(reassembled(records.where(F.coalesce("number", F.lit(0)) != n))).first()
    assert not tail.valid
    doubled = pages_from(reassembled(records.union(records))).collect()
    assert len(doubled) == 1 and doubled[0].valid


def test_parsing():
    one = record(b"response", b"urn:x:1", b"block\r\n\r\nWARC/1.1") + b"\r\n"
    two = record(b"revisit", b"urn:x:2", b"") + b"\r\n"
    for archive in (one + two, gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        assert [(f["warc-record-id"], b) for f, b in split_records(archive)] == [
            ("<urn:x:1>", b"block\r\n\r\nWARC/1.1"), ("<urn:x:2>", b"")]
    assert [b for _, b in split_records(one + two[:-20])] == [b"block\r\n\r\nWARC/1.1"]
    assert list(split_records(b"")) == []


@pytest.mark.parametrize("payload", [b"", b"x", "日本".encode() * 9, b"\r\n0\r\n\r\n"])
def test_chunks(payload):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert unchunked(head + chunked(payload, 5)) == payload
    assert unchunked(head + b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert unchunked(head + b"5\r\nabc\r\n0\r\n\r\n") is None
    assert unchunked(head + b"zz\r\n") is None
    assert unchunked(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"


def test_empty_table(spark):
    assert archive_report(pages(spark).limit(0)).count() == 0
