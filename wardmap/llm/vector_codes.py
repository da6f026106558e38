"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, fitted by ball k-means.

All arithmetic is on integers, so reruns agree to the last digit. Rows keep their entry numbers and squared distances
from round to round (a table written each round; the one before is deleted). In a round, an Arrow batch takes the parts
of an entry as a ball: twice the radius bounds which other entries can be nearest to any part of it (its neighbours). A
part within half the distance of the nearest neighbour is in the stable core and is left as it is; the others are in
annular rings, of which the n-th has n candidates, and only these are compared. Parts whose entry did not move compare
only with entries that did. Sums of entries are kept and changed by the parts that change their entry, so that only these
are read for the next codebook.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm.keys import write_table
from wardmap.session import delete_folder, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest component after scaling; squared distances of larger ones might not fit 64 bits.
LARGEST = 1 << 26


def nearest(x: np.ndarray, own: np.ndarray, distance: np.ndarray, book: np.ndarray, moved: np.ndarray) -> None:
    """Bring the entries ``own`` and squared distances of the parts ``x`` up to date with the codebook, in place.

    ``own`` was right for the codebook before; ``moved`` tells which entries are not what they were there.
    """
    fresh = moved[own]
    distance[fresh] = np.square(x[fresh] - book[own[fresh]]).sum(1)
    between = np.square(book[:, None] - book[None]).sum(2)
    by_entry = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[by_entry], np.arange(len(book) + 1))
    before = own.copy()
    for entry in range(len(book)):
        ball = by_entry[ends[entry]:ends[entry + 1]]
        others = np.flatnonzero(moved | moved[entry])
        others = others[others != entry]
        if not len(ball) or not len(others):
            continue
        # 2 d(part, entry) >= d(entry, other) is what lets another entry be as near.
        reach = 4 * distance[ball]
        others = others[between[entry, others] <= reach.max()]
        others = others[np.argsort(between[entry, others], kind="stable")]
        ring = np.searchsorted(between[entry, others], reach, "right")
        for n, other in enumerate(others):
            some = ball[ring > n]
            found = np.square(x[some] - book[other]).sum(1)
            better = (found < distance[some]) | (found == distance[some]) & (other < before[some])
            own[some[better]], distance[some[better]] = other, found[better]
            before[some[better]] = other


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Lists of equal length as the rows of a matrix of their own."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Rows with the nearest entries of a new codebook; ``was`` are those of the one before."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vector"), np.int64)
            if x.shape[1] != parts * width or np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"vectors need {parts * width} components of at most {LARGEST} after scaling")
            was, distance = matrix(batch.column("codes"), np.int32), matrix(batch.column("distances"), np.int64)
            own = np.maximum(was, 0)
            for p in range(parts):
                codes, found = own[:, p].copy(), distance[:, p].copy()
                nearest(x[:, p * width:(p + 1) * width], codes, found, books[p], moved[p])
                own[:, p], distance[:, p] = codes, found
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vector"), lists(own), lists(was), lists(distance)],
                ["row", "vector", "codes", "was", "distances"])

    return rows.select("row", "vector", "codes", "distances").mapInArrow(
        run, f"row {rows.schema['row'].dataType.simpleString()}, vector array<bigint>, codes array<int>, was array<int>, "
             "distances array<bigint>")


def changes(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and counts of entries change: a row for each entry comes to the driver."""
    parts, entries, width = shape

    def run(batches):
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vector"), np.int64)
            new, old = matrix(batch.column("codes"), np.int32), matrix(batch.column("was"), np.int32)
            for p in range(parts):
                for codes, sign in ((new[:, p], 1), (old[:, p], -1)):
                    some = (new[:, p] != old[:, p]) & (codes >= 0)
                    np.add.at(sums[p], codes[some], sign * x[some, p * width:(p + 1) * width])
                    np.add.at(counts[p], codes[some], sign)
        part, entry = (a.reshape(-1).astype(np.int32) for a in np.indices(shape[:2]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts.reshape(-1)), lists(sums.reshape(parts * entries, width))],
            ["part", "entry", "n", "sums"])

    totals = rows.where("codes <> was").select("vector", "codes", "was").mapInArrow(
        run, "part int, entry int, n bigint, sums array<bigint>")
    totals = totals.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for part, entry, n, *total in totals.collect():
        counts[part, entry], sums[part, entry] = n, total
    return sums, counts


def vector_codes(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", columns: list[str] | None = None,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """The rows' ``columns`` (all but the vector) with ``codes`` and ``distances`` per part; and the codebooks.

    Rows without a vector, without components or with null or non-finite components are left out. A component x counts
    as floor(scale * x). A part's codebook starts as that part of the ``entries`` smallest ids (null last; of equal
    ids, the smallest vectors); in each round every part goes to its nearest entry, the lower number on ties, and
    entries become the rounded-down means of their parts, unused ones stay. All vectors need one length, a multiple of
    ``parts``. The codebooks are an array (part, entry, component). Without rows the codebooks are empty. Columns named
    ``codes`` or ``distances`` are replaced.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits")
    columns = [c for c in vectors.columns if c != vector_column] if columns is None else columns
    finite = F.forall(vectors[vector_column], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vectors[vector_column], lambda x: F.floor(x.cast("double") * scale))
    given = F.struct(vectors[id_column].alias("id"), *[vectors[c].alias(f"c{i}") for i, c in enumerate(columns)])
    rows = vectors.where(vectors[vector_column].isNotNull() & (F.size(vectors[vector_column]) > 0) & finite).select(
        given.alias("row"), whole.alias("vector"), F.array_repeat(F.lit(-1), parts).alias("codes"),
        F.array_repeat(F.lit(0).cast("long"), parts).alias("distances"))
    first = rows.orderBy(F.col("row.id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(first[0].vector) if first else 0
    if width % parts or any(len(r.vector) != width for r in first):
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, width // parts).swapaxes(0, 1)
    names = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in ("codes", "distances")]
    if not first:
        return rows.select(*names, "codes", "distances"), books

    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    moved, path = np.ones(books.shape[:2], bool), None
    for n in range(rounds + 1):
        rows, path, earlier = *write_table(assigned(rows, books, moved), "codes"), path
        if earlier:
            delete_folder(rows.sparkSession, earlier)
        if n == rounds:
            break
        more = changes(rows, books.shape)
        sums, counts = sums + more[0], counts + more[1]
        means = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], books)
        moved, books = (means != books).any(2), means
        if not moved.any():
            break
    return rows.select(*names, "codes", "distances"), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """Add ``approximation``: the vector that a row's codes stand for."""
    book = F.array(*[F.array(*[F.lit([float(x) / scale for x in entry]) for entry in part]) for part in books])
    parts = F.transform("codes", lambda code, p: F.get(F.get(book, p), code))
    return codes.withColumn("approximation", F.flatten(parts))


def code_report(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", **options,
) -> DataFrame:
    """vec_id, code (two hexadecimal digits per part), error, label_error and a digest of the codebooks."""
    codes, books = vector_codes(
        vectors.select(vectors[id_column].alias("vec_id"), vectors[vector_column].alias("vector"),
                       vectors[label_column].alias("label")), "vec_id", "vector", **options)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda total, d: total + d)
    rows = codes.select("vec_id", "label", F.array_join(digits, "").alias("code"), error.alias("error"))
    by_label = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = by_label.withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return rows.join(by_label, rows["label"].eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
