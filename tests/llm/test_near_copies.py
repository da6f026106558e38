import random

import numpy as np
import pytest
from conftest import FOLD, SPACED, documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from wardmap.llm import signature_tree
from wardmap.llm.near_copies import near_copy_report, without_near_copies


def shingle_set(text, k):
    w = SPACED.findall((text or "").translate(FOLD))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def expected(rows, k=3, num=90, den=100):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))),
                  key=repr)


def copies(n, length, seed):
    """A drifting family of copies: each changes a few words of an earlier one."""
    rng = random.Random(seed)
    family = [words(length, seed)]
    for _ in range(n):
        new = rng.choice(family).copy()
        for _ in range(rng.randint(0, max(1, length // 60))):
            new[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        family.append(new)
    return [" ".join(f) for f in family]


@pytest.fixture(scope="module")
def rows(edge_rows):
    texts = copies(60, 120, 3) + copies(40, 400, 4) + copies(20, 12, 5) + copies(30, 40, 6)
    random.Random(1).shuffle(texts)
    return [r[:2] for r in edge_rows] + [(100 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"block": 900}, {"block": 60}])
def test_components_equal_brute_force(spark, rows, options):
    docs = documents(spark, [(*r, "s") for r in rows])
    found = near_copy_report(docs, **options).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)


def test_five_words_and_four_fifths(spark, rows):
    docs = documents(spark, [(*r, "s") for r in rows])
    found = near_copy_report(docs, shingle=5, similarity=(80, 100)).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows, 5, 80, 100)


def test_one_of_each_group_stays(spark, rows):
    docs = documents(spark, [(*r, "s") for r in rows])
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    wordless = {(d, t) for d, t in rows if not SPACED.findall(t or "")}
    groups = {c for d, n, c in expected(rows) if n}
    assert ids == sorted([*groups, *[d for d, _ in wordless]], key=repr)


def test_empty_table(spark):
    docs = documents(spark, [(1, "x", "s")]).limit(0)
    assert near_copy_report(docs).count() == 0
    assert without_near_copies(docs).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 200))
def test_tree_joins_what_pairs_join(seed, n):
    rng = random.Random(seed)
    sets, family = [], []
    for _ in range(n):
        if family and rng.random() < 0.8:
            s = set(rng.choice(family))
            for _ in range(rng.randint(0, 3)):
                s.discard(rng.choice(sorted(s)))
                s.add(rng.getrandbits(64))
        else:
            s = {rng.getrandbits(64) for _ in range(rng.randint(1, 40))}
        family.append(s)
        sets.append(np.array(sorted(s), np.uint64))
    found = signature_tree.links(sets, np.arange(n), 9, 10)
    assert all(signature_tree.similar(sets[i], sets[j], 9, 10) for i, j in found)
    label = list(range(n))
    for i, j in found:
        assert label[i] != label[j]
        label = [label[i] if x == label[j] else x for x in label]
    for i in range(n):
        for j in range(i):
            if signature_tree.similar(sets[i], sets[j], 9, 10):
                assert label[i] == label[j]
