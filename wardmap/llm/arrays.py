"""Words, lines and hashes of an Arrow text column, computed over whole byte buffers.

The helpers run inside Arrow batch functions. They cut a batch into slices of about one megabyte (a longer
text is a slice of its own), so memory is bounded by the longest text, not by the batch. Hashes are 64 bits:
a span's bytes are mapped to random values, summed with powers of an odd base and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = np.asarray(h, _U)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def random_values(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASE = _U(0x9E3779B97F4A7C55)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
GRAM_FACTORS = random_values(64, 7) | _U(1)

BYTES = random_values(256, 11)
LOWERED = BYTES.copy()
LOWERED[ord("A"):ord("Z") + 1] = BYTES[ord("a"):ord("z") + 1]

#: Bytes of words: anything but white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: ASCII letters and digits, and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Texts(NamedTuple):
    """Consecutive texts: their bytes, and where each begins (one entry more than texts)."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Spans(NamedTuple):
    """Spans of bytes in row order; ``first[i]`` is the number of spans before row ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) for consecutive rows of at most ``limit`` bytes; a null is an empty text."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, Texts(data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
        start = stop


def find_spans(texts: Texts, inside: np.ndarray) -> Spans:
    """Longest runs of bytes of the set ``inside`` (a mask over the 256 byte values), within rows."""
    marked = inside[texts.data]
    before, after = np.zeros_like(marked), np.zeros_like(marked)
    before[1:], after[:-1] = marked[:-1], marked[1:]
    full = texts.offsets[:-1] < texts.offsets[1:]
    before[texts.offsets[:-1][full]] = False
    after[texts.offsets[1:][full] - 1] = False
    starts = np.flatnonzero(marked & ~before)
    return Spans(starts, np.flatnonzero(marked & ~after) + 1, np.searchsorted(starts, texts.offsets))


def find_lines(texts: Texts) -> Spans:
    r"""Pieces between ``\n``, empty ones too; an empty text is one empty line."""
    breaks = np.flatnonzero(texts.data == 0x0A)
    starts = np.sort(np.concatenate([texts.offsets[:-1], breaks + 1]), kind="stable")
    per_row = np.diff(np.searchsorted(breaks, texts.offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])
    # A line ends before its break, or with its text.
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = texts.offsets[1:]
    return Spans(starts, ends, first)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the worker's next slices."""
    for i, base in enumerate((_BASE, _INVERSE)):
        if len(_POWERS[i]) < n:
            steps = np.full(max(n, SLICE_BYTES + 1), base, _U)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTES) -> np.ndarray:
    """Sums of the values of all bytes before each place, times powers of the base."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * up[:-1], out=sums[1:])
    return sums


def span_hashes(texts: Texts, spans: Spans, values: np.ndarray = BYTES) -> np.ndarray:
    """A hash of each span's bytes; ``LOWERED`` as values folds A-Z."""
    sums = prefix_sums(texts.data, values)
    _, down = powers(len(texts.data) + 1)
    return mix((sums[spans.ends] - sums[spans.starts]) * down[spans.starts] + (spans.ends - spans.starts).astype(_U))


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``k`` consecutive items from each item on; ``k - 1`` fewer entries than items."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, seed + k, _U)
    for j in range(k):
        total += hashes[j:j + n] * GRAM_FACTORS[j]
    return mix(total)


def whole_rows(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the ``k`` consecutive items from each item on are of one row."""
    n = max(0, len(row) - k + 1)
    return row[:n] == row[k - 1:k - 1 + n]


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a few rows, for code that turns values into Python objects."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def list_column(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Arrow lists of consecutive values, ``counts`` of them each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
