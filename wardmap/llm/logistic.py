"""Logistic regression over hashed sparse features: fit on a bounded sample, calibrated on held-out rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Sparse(NamedTuple):
    """Rows of (column, value) pairs; ``first[i]`` is where row ``i`` begins."""

    columns: np.ndarray
    values: np.ndarray
    first: np.ndarray

    def rows(self, chosen: np.ndarray) -> Sparse:
        counts = np.diff(self.first)
        use = np.repeat(chosen, counts)
        return Sparse(self.columns[use], self.values[use], np.concatenate([[0], np.cumsum(counts[chosen])]))


#: Values worked on at a time.
PIECE = 1 << 20


def pieces(x: Sparse) -> Iterator[tuple[slice, Sparse]]:
    """Consecutive rows with about ``PIECE`` values, and where they are."""
    start, rows = 0, len(x.first) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(x.first, x.first[start] + PIECE, "right")) - 1)
        values = slice(x.first[start], x.first[stop])
        yield slice(start, stop), Sparse(x.columns[values], x.values[values], x.first[start:stop + 1] - x.first[start])
        start = stop


def margins(x: Sparse, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(x.first) - 1, bias, np.float64)
    for rows, part in pieces(x):
        sums = np.concatenate([[0.0], np.cumsum(weights[part.columns] * part.values, dtype=np.float64)])
        out[rows] += sums[part.first[1:]] - sums[part.first[:-1]]
    return out


def probabilities(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Sparse, y: np.ndarray, dimensions: int, penalty: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; both classes weigh the same in total."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    squares = np.zeros(len(y))
    for rows, part in pieces(x):
        each = np.repeat(np.arange(rows.stop - rows.start), np.diff(part.first))
        squares[rows] = np.bincount(each, weights=part.values.astype(np.float64) ** 2, minlength=rows.stop - rows.start)
    rate = 1.0 / (0.25 * (1.0 + float((share * squares).sum()) + penalty))
    w, v, b, c = np.zeros(dimensions), np.zeros(dimensions), 0.0, 0.0
    for step in range(steps):
        error = share * (probabilities(margins(x, v, c)) - y)
        slope = np.zeros(dimensions)
        for rows, part in pieces(x):
            slope += np.bincount(part.columns, weights=np.repeat(error[rows], np.diff(part.first)) * part.values,
                                 minlength=dimensions)
        nw, nb = v - rate * (slope + penalty * v), c - rate * error.sum()
        pull = step / (step + 3.0)
        v, c, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, b


def calibrate(z: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift so that ``probabilities(slope * z + shift)`` fits weighted held-out rows.

    One smoothed count per class keeps the slope finite where the classes are apart.
    """
    n1, n0 = share[y == 1].sum(), share[y == 0].sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(z)), 1e-9)
    u, a, s = z / scale, 1.0, 0.0
    for _ in range(steps):
        p = probabilities(a * u + s)
        g = np.array([(share * (p - goal) * u).sum(), (share * (p - goal)).sum()])
        q = share * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * u * u).sum() + 1e-6, (q * u).sum()], [(q * u).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        a, s = a - step[0], s - step[1]
    return a / scale, s
