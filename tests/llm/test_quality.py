import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SPACED, documents, words

from wardmap.llm import logistic
from wardmap.llm.quality import assess, good_documents, quality_report, train
from wardmap.llm.tables import table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def expected(text):
    text = text or ""
    w = SPACED.findall(text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            doubled += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counts_equal_brute_force(spark, edge_rows):
    docs = documents(spark, edge_rows)
    rows = assess(docs, None).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert tuple(r[-1][c] for c in COUNTS) == expected(r.text)
        assert r[-1]["kept"] == (not r[-1]["base_failed"])
        assert r.kept is True  # the table's own column


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = train(docs, labels, sample=200)
    rows = assess(docs.select("doc_id", "text"), model).join(labels, "doc_id").where("not __quality.base_failed")
    held = rows.select("quality", "__quality.probability").collect()
    assert len(held) > 2000
    right = sum((r.probability >= 0.5) == (r.quality == 1) for r in held)
    assert right / len(held) > 0.97
    # Calibrated: among texts, mean probability is near the share of good ones.
    assert abs(np.mean([r.probability for r in held]) - np.mean([r.quality for r in held])) < 0.05


def test_training_is_repeatable_and_passes_over_bad_labels(spark, edge_rows):
    rng = random.Random(4)
    rows = [(i, " ".join(words(80, i)) + (" ###" * 30 if i % 2 else ""), "s") for i in range(60)] + edge_rows
    docs = documents(spark, rows + rows[:5])
    labels = [(i, 1 - i % 2, 0) for i in range(60)] + [(0, 0, 0), (None, 1, 0), (2, None, 0), (999, 0, 0), (3, 7, 0)]
    labels += labels[:3]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = train(docs, frame, sample=25)
    rng.shuffle(labels)
    b = train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=25)
    assert np.array_equal(a.weights, b.weights) and a[1:] == b[1:]
    report = {r.doc_id: r for r in quality_report(docs, frame).collect()}
    assert report[4].kept and not report[5].kept and not report[1].kept


def test_without_labels_the_rules_decide(spark, edge_rows):
    docs = documents(spark, edge_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(9, 1, 0)], none.schema)):
        assert train(docs, labels) is None
        kept = good_documents(docs, labels)
        assert kept.columns == docs.columns
        assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(
            repr(d) for d, t, _ in edge_rows if not expected(t)[-1])
    assert quality_report(docs.limit(0), none).count() == 0


def test_logistic_separates_and_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    columns = np.stack([y + 2 * rng.integers(0, 2, 400), 4 + rng.integers(0, 50, 400)], axis=1).ravel()
    x = logistic.Sparse(columns, np.ones(800), np.arange(0, 801, 2))
    w, b = logistic.fit(x, y, 64)
    z = logistic.margins(x, w, b)
    slope, shift = logistic.calibrate(z, y, np.ones(400))
    assert ((logistic.probabilities(slope * z + shift) > 0.5) == y).all()


@pytest.mark.parametrize("text,dups", [("a\na", 1), ("a\r\na", 0), (" a\na", 0), ("\n\n", 0), ("a\n\na\n", 1)])
def test_equal_lines(spark, text, dups):
    assert assess(documents(spark, [(1, text, "s")]), None).first()[-1]["n_dup_lines"] == dups
