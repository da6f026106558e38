"""Signature tree: finds the similar pairs among the token sets of one block.

A set has a bitmap with the bits of its tokens set. A node of the tree holds the OR of its members' bitmaps,
their range of sizes and their slack, the most by which a size exceeds the bits set. Two sets below two nodes
share at most as many tokens as the nodes share bits, plus the smaller slack; node pairs whose bound misses
what the smallest sizes need, or whose sizes are too far apart, are pruned with all pairs below them. Pairs of
members that pass their own bound are compared exactly.

Only links that join two components are wanted, so node pairs that lie in one component are passed over.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 16, 8
LEAST_BITS, MOST_BITS = 256, 1 << 14


class Level:
    """Nodes of one level: bitmaps, sizes, slack, and the members ``first[i]`` to ``first[i + 1]`` below each."""

    def __init__(self, bitmaps, least, most, slack, first):
        self.bitmaps, self.least, self.most, self.slack, self.first = bitmaps, least, most, slack, first

    def above(self, fan: int) -> Level:
        heads = np.arange(0, len(self.least), fan)
        return Level(
            np.bitwise_or.reduceat(self.bitmaps, heads, axis=0), np.minimum.reduceat(self.least, heads),
            np.maximum.reduceat(self.most, heads), np.maximum.reduceat(self.slack, heads),
            np.append(self.first[heads], self.first[-1]))


def members_of(sets: list[np.ndarray]) -> Level:
    sizes = np.array([len(s) for s in sets])
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 8 * sizes.max()):
        bits *= 2
    bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
    place = (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(bitmaps, (np.repeat(np.arange(len(sets)), sizes), place >> 6),
                     np.uint64(1) << (place & 63).astype(np.uint64))
    slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
    return Level(bitmaps, sizes, sizes, slack, np.arange(len(sets) + 1))


def possible(a: Level, i: slice, b: Level, j: slice, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold sets of at least ``num / den`` similarity."""
    shared = np.bitwise_count(a.bitmaps[i][:, None, :] & b.bitmaps[j][None, :, :]).sum(axis=2, dtype=np.int64)
    overlap = shared + np.minimum(a.slack[i][:, None], b.slack[j][None, :])
    overlap = np.minimum(overlap, np.minimum(a.most[i][:, None], b.most[j][None, :]))
    least = a.least[i][:, None] + b.least[j][None, :]
    near = (den * a.most[i][:, None] >= num * b.least[j][None, :]) & (
        den * b.most[j][None, :] >= num * a.least[i][:, None])
    return near & ((den + num) * overlap >= num * least)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def links(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (places in ``sets``) of similar sets that join components; ``labels`` are the components so far.

    After the pairs are joined, every similar pair lies in one component, and only those do.
    """
    if len(sets) < 2:
        return []
    order = np.lexsort(([s.min() for s in sets], [len(s) for s in sets]))
    sets = [sets[i] for i in order]
    label = np.unique(labels[order], return_inverse=True)[1]
    levels = [members_of(sets)]
    levels.append(levels[0].above(LEAF))
    while len(levels[-1].least) > 1:
        levels.append(levels[-1].above(FAN))
    found = []

    def one_component(level: Level, i: int, j: int) -> bool:
        x, y = label[level.first[i]:level.first[i + 1]], label[level.first[j]:level.first[j + 1]]
        return x[0] == y[0] and (x == x[0]).all() and (y == y[0]).all()

    def visit(depth: int, i: int, j: int) -> None:
        """All pairs below node ``i`` and node ``j`` of a level."""
        if one_component(levels[depth], i, j):
            return
        below = levels[depth - 1]
        fan = LEAF if depth == 1 else FAN
        n = len(below.least)
        left, right = slice(i * fan, min(n, i * fan + fan)), slice(j * fan, min(n, j * fan + fan))
        open_ = possible(below, left, below, right, num, den)
        if i == j:
            open_ = np.triu(open_, 1 if depth == 1 else 0)
        if depth > 1:
            pairs = sorted(zip(*np.nonzero(open_), strict=True), key=lambda p: abs(p[0] + left.start - p[1] - right.start))
            for x, y in pairs:
                visit(depth - 1, left.start + int(x), right.start + int(y))
            return
        while True:
            x, y = np.nonzero(open_ & (label[left][:, None] != label[right][None, :]))
            if not len(x):
                return
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                open_[p, q] = False
                u, v = left.start + p, right.start + q
                if label[u] != label[v] and similar(sets[u], sets[v], num, den):
                    found.append((int(order[u]), int(order[v])))
                    label[label == label[v]] = label[u]
                    break

    visit(len(levels) - 1, 0, 0)
    return found
