import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from wardmap.llm.sql import vector_codes_sql
from wardmap.llm.vector_codes import code_report, decoded, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, row int, codes string, distances string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA)


def expected(rows, parts=8, entries=16, rounds=6):
    """Plain k-means in whole numbers."""
    kept = [(i, tuple(math.floor(4096 * x) for x in v), label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w:(p + 1) * w] for r in kept] for p in range(parts)]
    books = [[r[1][p * w:(p + 1) * w] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        codes = [[min((far(x, e), j) for j, e in enumerate(books[p])) for x in cut[p]] for p in range(parts)]
        if n < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    mine = [x for x, (_, c) in zip(cut[p], codes[p], strict=True) if c == j]
                    if mine:
                        books[p][j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    errors = [sum(codes[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{codes[p][n][1]:02x}" for p in range(parts)), errors[n], by_label[label], digest)
                   for n, (i, _, label) in enumerate(kept)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(seed, n, dim, grid=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    for i in range(n):
        v = [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]
        yield i, [round(x * grid) / grid for x in v] if grid else v, rng.choice([None, 1, 2])


@pytest.mark.parametrize("grid", [None, 1, 2])
def test_against_plain_k_means(spark, grid):
    # A coarse grid makes many ties, equal vectors and equal entries.
    rows = list(vectors(grid or 0, 700, 16, grid))
    assert found(code_report(table(spark, rows).repartition(5))) == expected(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, None, 1), (4, [], 1), (3, [nan] + [0.0] * 7, 1), (2, [None] + [0.0] * 7, 1), (1, [inf] + [0.0] * 7, 1),
            (None, [0.5] * 8, None), (9, [-0.0001] * 8, 3), (9, [0.25] * 8, 3), (9, [0.25] * 8, None), (7, [-3.0] * 8, 3)]
    assert found(code_report(table(spark, rows))) == expected(rows)
    few = rows[:6]
    assert found(code_report(table(spark, few))) == expected(few)


def test_empty_and_unequal(spark):
    assert found(code_report(table(spark, []))) == []
    with pytest.raises(ValueError, match="one length"):
        code_report(table(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(Exception, match="vectors need"):
        code_report(table(spark, [(i, [1.0] * (8 if i < 30 else 16), 1) for i in range(40)]))


def test_columns_and_approximations(spark):
    rows = list(vectors(4, 200, 16))
    codes, books = vector_codes(table(spark, rows))
    assert codes.columns == ["vec_id", "label", "row", "vector", "codes", "distances"] and books.shape == (8, 16, 2)
    known = {i: v for i, v, _ in rows}
    for r in decoded(codes, books).collect():
        error = sum((math.floor(4096 * x) - 4096 * y) ** 2 for x, y in zip(known[r.vec_id], r.approximation, strict=True))
        assert round(error) == sum(r.distances)
    assert codes.agg(F.sum(F.size("codes"))).first()[0] == 1600


def test_stable_balls_are_not_read():
    rng = np.random.default_rng(1)
    book = np.array([[0, 0], [100, 0], [0, 100]])
    x = rng.integers(-20, 20, (300, 2)) + book[rng.integers(0, 3, 300)]
    own, distance = np.zeros(300, np.int32), np.zeros(300, np.int64)
    nearest(x, own, distance, book, np.ones(3, bool))
    every = np.square(x[:, None] - book[None]).sum(2)
    assert (own == every.argmin(1)).all() and (distance == every.min(1)).all()
    # Nothing moved: wrong distances stay, as no part is looked at.
    distance[:] = 1
    nearest(x, own, distance, book, np.zeros(3, bool))
    assert (distance == 1).all()


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert differences(code_report(given), connect(folder), vector_codes_sql()) == ""
