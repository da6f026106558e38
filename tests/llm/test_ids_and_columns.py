"""Ids of any type, and tables with columns named like those that operators use."""

import pytest
from conftest import documents, words

from wardmap.llm.decontaminate import contamination_report, without_contaminated
from wardmap.llm.exact_copies import without_exact_copies
from wardmap.llm.licences import licence_scan
from wardmap.llm.mixing import mixed, mixture_report
from wardmap.llm.near_copies import near_copy_report, without_near_copies
from wardmap.llm.packing import packed
from wardmap.llm.quality import good_documents, quality_report
from wardmap.llm.warc import archive_report


@pytest.fixture(scope="module")
def texts():
    base = words(80, 3)
    near = [*base[:70], "changed", *base[71:]]
    return [("doc-2", " ".join(base), "a"), ("doc-1", " ".join(near), "b"), ("doc-3", " ".join(words(90, 9)), None),
            (None, "", "a"), ("doc-3", " ".join(words(90, 9)), None)]


def named(spark, rows, kind):
    number = {"string": lambda i: i, "int": lambda i: i and int(i[-1]), "decimal(5,0)": lambda i: i and __import__("decimal").Decimal(i[-1])}
    return spark.createDataFrame([(number[kind](i), t, s) for i, t, s in rows], f"doc_id {kind}, text string, source string")


@pytest.mark.parametrize("kind", ["string", "int", "decimal(5,0)"])
def test_ids_keep_their_type(spark, texts, kind):
    docs = named(spark, texts, kind)
    items = spark.createDataFrame([("q-1", " ".join(words(90, 9)[20:40]))], "item_id string, text string")
    ids = sorted((str(r.doc_id) for r in docs.collect()))
    for found in (contamination_report(docs, items), near_copy_report(docs), mixture_report(docs), licence_scan(docs),
                  quality_report(docs, docs.selectExpr("doc_id", "1 quality"))):
        assert found.schema["doc_id"].dataType.simpleString() == kind
        assert sorted(str(r.doc_id) for r in found.collect()) == ids
    linked = {str(r.doc_id): str(r.component_id) for r in near_copy_report(docs, shingle=3, similarity=(80, 100)).collect()}
    first, second = ("doc-1", "doc-2") if kind == "string" else ("1", "2")
    assert linked[first] == linked[second] == first
    assert {str(r.doc_id) for r in without_contaminated(docs, items).collect()} == {first, second, "None"}
    assert {str(i) for r in packed(docs).collect() for i in r.doc_ids} == set(ids) - {"None"}


def test_pages_with_named_ids(spark):
    rows = [("a/b:c", "u", "<p>x</p>"), ("", "u", "<p>x</p>"), (None, "u", "<p>y</p>"), ("ü +%", None, "<p>z</p>")]
    found = {r.page_id: r for r in archive_report(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(found) == {"a/b:c", "", None, "ü +%"}
    assert found[""].refers_to == "a/b:c" and found["a/b:c"].record_type == "response"


def test_clashing_columns_pass_through(spark, edge_rows):
    docs = documents(spark, edge_rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "no such words anywhere at all")], "item_id long, text string")
    for found in (without_near_copies(docs), mixed(docs), good_documents(docs, labels), without_contaminated(docs, items),
                  without_exact_copies(docs)):
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} <= {tuple(r) for r in docs.collect()}


def test_short_items_drop_no_document(spark):
    docs = documents(spark, [(1, "many words of a text that also says hello somewhere", "a"), (2, "five words of an item stand here", "a")])
    items = spark.createDataFrame([(1, "hello"), (2, "five words of an item")], "item_id long, text string")
    assert [r.doc_id for r in without_contaminated(docs, items, least_words=5).collect()] == [1]
    assert {r.doc_id: r.contaminated for r in contamination_report(docs, items).collect()} == {1: True, 2: True}
