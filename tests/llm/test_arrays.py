import re

import pyarrow as pa
from conftest import ALNUM, SPACED
from hypothesis import given, settings
from hypothesis import strategies as st

from wardmap.llm import arrays

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1é \n\t#日", max_size=30)), max_size=12)


def pieces(texts, spans, i):
    return [texts.data[a:b].tobytes().decode() for a, b in zip(
        spans.starts[spans.first[i]:spans.first[i + 1]], spans.ends[spans.first[i]:spans.first[i + 1]], strict=True)]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_lines_are_those_of_the_patterns(values, limit):
    seen = 0
    for start, texts in arrays.text_slices(pa.array(values, pa.string()), limit):
        assert start == seen
        seen += texts.rows
        spaced, alnum = arrays.find_spans(texts, arrays.SPACED), arrays.find_spans(texts, arrays.ALPHANUMERIC)
        lines = arrays.find_lines(texts)
        for i in range(texts.rows):
            text = values[start + i] or ""
            assert pieces(texts, spaced, i) == SPACED.findall(text)
            assert [w.lower() for w in pieces(texts, alnum, i)] == ALNUM.findall(text.lower())
            assert pieces(texts, lines, i) == text.split("\n")
    assert seen == len(values)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_are_equal_for_equal_words_only(values):
    column = pa.array(values, pa.string())
    by_hash = {}
    for _, texts in arrays.text_slices(column, 16):
        spans = arrays.find_spans(texts, arrays.SPACED)
        hashes = arrays.span_hashes(texts, spans, arrays.LOWERED)
        found = [w for i in range(texts.rows) for w in pieces(texts, spans, i)]
        for word, value in zip(found, hashes.tolist(), strict=True):
            folded = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            assert by_hash.setdefault(value, folded) == folded
    assert len(set(by_hash.values())) == len(by_hash)


def test_sliced_columns_and_long_texts():
    column = pa.array(["x"] * 5 + ["long " * 1000, None, "end"]).slice(4, 4)
    rows = [(start, texts.rows) for start, texts in arrays.text_slices(column, 100)]
    assert rows == [(0, 1), (1, 1), (2, 2)]
