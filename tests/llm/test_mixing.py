import math
from collections import Counter, defaultdict

import pytest
from compare import canonical, connect, differences
from conftest import SMALL, SPACED, documents, words

from wardmap.llm.mixing import MOST, SEED, SHARE, WEIGHTS, mixed, mixture_report, offset_of
from wardmap.llm.queries import QUERIES
from wardmap.llm.sql import ORACLE


def expected(rows):
    """The rule of the mixture, step by step."""
    sizes = [(d, len(SPACED.findall(t or "")), s) for d, t, s in rows]
    total = Counter()
    for _, n, s in sizes:
        total[s] += n
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(sources)}
    target, full, left = {}, set(), SHARE * sum(total.values())
    while True:
        free = [s for s in sources if s not in full]
        share = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > MOST * total[s]] if free else []
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
        for s in over:
            full.add(s)
            target[s] = float(MOST * total[s])
        left = SHARE * sum(total.values()) - sum(target[s] for s in full)
    by_source = defaultdict(list)
    for d, n, s in sizes:
        by_source[s].append((n, d is None, d or 0, d))
    out = []
    for s, docs in by_source.items():
        step = target[s] / total[s] if total[s] else 0.0
        for i, (n, _, _, d) in enumerate(sorted(docs), 1):
            copies = math.floor(offset_of(SEED) + step * i) - math.floor(offset_of(SEED) + step * (i - 1))
            out.append((d, n, total[s], round(target[s], 6), copies * n))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(edge_rows):
    return edge_rows + [(100 + i, " ".join(words(1 + i * 7 % 90, i)), "abcdefgh"[i % 8]) for i in range(300)]


def test_report_equals_brute_force(spark, rows):
    found = mixture_report(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found), key=repr) == expected(rows)


def test_targets_are_met(spark, rows):
    found = mixture_report(documents(spark, rows)).collect()
    assert all(r.taken <= 2 * r.size for r in found)
    by_target = defaultdict(list)
    for r in found:
        by_target[(r.source_size, r.target)].append(r)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(SPACED.findall(text or ""))
    alone = [n for n, k in Counter(sizes.values()).items() if k == 1]
    assert len(alone) > 5
    for (size, target), docs in by_target.items():
        assert size not in alone or abs(sum(r.taken for r in docs) - target) <= max(r.size for r in docs) + 1e-6


def test_mixture_repeats_documents_with_all_columns(spark, rows):
    docs = documents(spark, rows)
    out = mixed(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for d, n, _, _, words_taken in expected(rows):
        taken[d] += words_taken // n if n else 0
    got = Counter(r.doc_id for r in out.collect() if SPACED.findall(r.text or ""))
    assert got == +taken
    assert canonical(out.columns, out.collect()) == canonical(out.columns, mixed(docs.repartition(3)).collect())


def test_empty_tables(spark, rows):
    docs = documents(spark, rows[:2])
    assert mixture_report(docs.limit(0)).count() == 0
    assert mixed(docs.limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixture_report(docs).collect()] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == ""
