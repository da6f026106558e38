import hashlib
import re
from collections import defaultdict

from conftest import documents
from wardmap.llm.exact_copies import copy_report, exact_copies, without_exact_copies

BLANK = re.compile("[\x20\x09-\x0d]")


def expected(rows):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0, digest))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_edges_against_brute_force(spark, edge_rows):
    assert found(copy_report(documents(spark, edge_rows))) == expected(edge_rows)


def test_prefix_collisions_and_full_bitmaps(spark):
    rows = [(i, "a" * 300 + "bcd"[i % 3] + " " * (i % 5), "s") for i in range(200)]
    rows += [(i, "x" * (i % 40) + "yz"[i % 2], "s") for i in range(200, 400)]
    for options in ({}, {"bitmap_bits": 6}, {"prefix": 1}):
        assert found(copy_report(documents(spark, rows), **options)) == expected(rows)


def test_only_texts_with_company_are_read_in_full(spark):
    rows = [(1, "one text", "a"), (2, "another, longer text", "a"), (3, "onet ext", "a"), (4, "two text", "a")]
    digests = {r.doc_id: r.text_sha256 for r in exact_copies(documents(spark, rows)).collect()}
    assert digests[2] is None and digests[4] is None
    assert digests[1] == digests[3] == hashlib.sha256(b"onetext").hexdigest()


def test_columns_and_ids(spark):
    rows = [("doc-1", "a b", 1, True, "row"), ("doc-0", "ab ", 2, False, "row"), (None, None, 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, number int, kept boolean, digest string")
    out = {r.doc_id: r for r in exact_copies(docs).collect()}
    assert out["doc-1"].keep_id == "doc-0" and not out["doc-1"].kept and out["doc-1"].number == 1
    assert out[None].kept and out[None].keep_id is None
    kept = without_exact_copies(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[1:], key=repr)


def test_empty_table(spark):
    docs = documents(spark, [])
    assert copy_report(docs).collect() == []
    assert without_exact_copies(docs).columns == docs.columns
