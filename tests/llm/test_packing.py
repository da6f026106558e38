from collections import defaultdict

import numpy as np
import pytest
from conftest import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from wardmap.llm.packing import VOCABULARY, best_fit, encoder, packed, write_packed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_is_the_plain_rule(lengths):
    lengths = np.array(lengths, np.int64)
    rows: list[int] = []
    expected = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rows if r >= lengths[i]]
        if fits:
            rows.remove(min(fits))
            rows.append(min(fits) - lengths[i])
        else:
            rows.append(20 - lengths[i])
        expected[i] = sorted(rows)
    row_of = best_fit(lengths, 20)
    used = np.bincount(row_of, weights=lengths) if len(lengths) else np.zeros(0)
    assert (used <= 20).all()
    assert sorted(20 - used) == sorted(r for r in rows)


@pytest.mark.parametrize("length,block", [(64, 500), (2048, 4_000_000), (1, 50)])
def test_round_trip(spark, edge_rows, length, block):
    rows = [r for r in edge_rows if length > 1 or len(r[1] or "") < 3000]
    with open(VOCABULARY, "rb") as file:
        encoding, end = encoder(file.read())
    found = packed(documents(spark, rows), length=length, block_tokens=block).collect()
    assert len({r.pack_id for r in found}) == len(found)
    pieces = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == length and r.n_tokens == r.cu_seqlens[-1] <= length
        assert r.cu_seqlens == [0, *[s.start + s.length for s in r.segments]]
        assert r.position_resets == [s.start for s in r.segments] == r.cu_seqlens[:-1]
        assert r.doc_ids == [s.doc_id for s in r.segments]
        assert (ids[r.n_tokens:] == end).all()
        for s in r.segments:
            pieces[(s.doc_id, s.row_hash, s.pieces, s.piece)].append(tuple(ids[s.start:s.start + s.length]))
    texts = []
    for (doc, row, n, piece), same in pieces.items():
        if piece == 0:
            for copy in range(len(same)):
                ids = np.concatenate([pieces[(doc, row, n, p)][copy] for p in range(n)])
                assert ids[-1] == end and end not in ids[:-1]
                texts.append((doc, encoding.decode(ids[:-1].tolist())))
    assert sorted(texts, key=repr) == sorted(((d, t) for d, t, _ in rows if t), key=repr)


def test_written_rows_and_empty_table(spark, edge_rows, tmp_path):
    docs = documents(spark, edge_rows)
    write_packed(docs, str(tmp_path / "packed"), length=256)
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packed(docs, length=256).count()
    assert packed(docs.limit(0)).count() == 0
    assert packed(documents(spark, edge_rows[:2])).count() == 0
