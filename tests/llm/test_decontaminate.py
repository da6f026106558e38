import hashlib

import pytest
from conftest import ALNUM, FOLD, documents, words

from wardmap.llm.decontaminate import contamination, contamination_report, without_contaminated

LONG = words(60, 5)
ITEMS = [(1, " ".join(LONG)), (2, "one"), (3, "Three, MORE words"), (4, ""), (5, None), (6, " ".join(words(9, 6))),
         (7, " ".join(LONG[20:45])), (7, " ".join(LONG[20:45])), (None, "two words"), (10, "...")]


def expected(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    more = [(20, " ".join(["before", *LONG[5:15], "after"]), "a"), (21, " ".join(LONG[5:14]), "a"),
            (22, " ".join(LONG[:12] + ["x"] + LONG[12:50]).upper(), "a"), (23, " ".join(words(9, 6) * 3), "a"),
            (24, ", ".join(LONG * 3), "a"), (25, "a two  words\ntwo-words three more words", "a")]
    return edge_rows + more + more[:1]


def test_edge_cases_equal_brute_force(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination_report(documents(spark, rows), items).collect()
    assert sorted(map(tuple, found), key=repr) == expected([r[:2] for r in rows], ITEMS)


@pytest.mark.parametrize("window,gram", [(4, 2), (6, 6), (3, 8)])
def test_other_windows(spark, rows, window, gram):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination_report(documents(spark, rows[-8:]), items, window=window, gram=gram).collect()
    assert sorted(map(tuple, found), key=repr) == expected([r[:2] for r in rows[-8:]], ITEMS, window)


def test_small_bitmap_changes_nothing(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contamination_report(documents(spark, rows), items, bitmap_bits=6).collect()
    assert sorted(map(tuple, found), key=repr) == expected([r[:2] for r in rows], ITEMS)


def test_filter_keeps_columns_and_clean_rows(spark, rows):
    docs = documents(spark, rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = without_contaminated(docs, items)
    clean = [e[0] for e in expected([r[:2] for r in rows], ITEMS) if not e[-1]]
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, clean))


def test_empty_tables(spark, rows):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, rows[:6])
    assert contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in contamination_report(docs, items).collect())
    assert without_contaminated(docs, items).count() == 6
