from collections import Counter

import corpus_pipeline
import pytest
import test_decontaminate
import test_mixing
import test_near_copies
import test_quality
from conftest import SMALL

from wardmap.llm.quality import quality_report
from wardmap.llm.tables import table
from wardmap.session import stored


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before and after each stage."""
    docs = [table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SMALL), name))
    return docs


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "mix_sources", "pack"]
    assert all(df.columns == steps[0].columns and df.schema == steps[0].schema for df in steps[:-1])


def test_quality_drops_what_the_report_rejects(spark, steps):
    report = quality_report(steps[0], table(spark, SMALL, "labels")).collect()
    assert {d for d, _ in pairs(steps[1])} == {r.doc_id for r in report if r.kept}
    failed = {d for d, t in pairs(steps[0]) if test_quality.expected(t)[-1]}
    assert not failed & {d for d, _ in pairs(steps[1])}


def test_one_of_each_group_of_near_copies_stays(steps):
    groups = test_near_copies.expected(pairs(steps[1]), 5, 80, 100)
    assert sorted(d for d, _ in pairs(steps[2])) == sorted({c for _, n, c in groups if n})


def test_no_window_of_the_benchmark_is_left(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = [e[0] for e in test_decontaminate.expected(pairs(steps[2]), items) if not e[-1]]
    assert sorted(d for d, _ in pairs(steps[3])) == sorted(clean)


def test_mixture_and_packed_rows_hold_the_same_documents(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[3].select("doc_id", "text", "source").collect()]
    taken = Counter({d: words // n for d, n, _, _, words in test_mixing.expected(rows) if n})
    assert Counter(d for d, _ in pairs(steps[4])) == +taken
    packed = Counter(s.doc_id for r in steps[5].collect() for s in r.segments if s.piece == 0)
    assert packed == +taken


def test_run_gives_the_last_stage(spark, steps):
    whole = Counter(s.doc_id for r in corpus_pipeline.run(spark, SMALL).collect() for s in r.segments if s.piece == 0)
    assert whole == Counter(s.doc_id for r in steps[5].collect() for s in r.segments if s.piece == 0)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_pass_over_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
