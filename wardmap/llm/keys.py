"""Row identity, salted joins and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.session import new_path, stored

#: A row is known by its id and a hash of its text; rows equal in both are interchangeable.
ROW_ID, ROW_HASH = "__row_id", "__row_hash"


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, in its own type, text hash and text under names of their own, whatever else the table holds."""
    return df.select(
        df[id_column].alias(ROW_ID),
        F.xxhash64(df[text_column]).alias(ROW_HASH),
        df[text_column].cast("string").alias("__text"),
    )


def type_of(df: DataFrame, column: str) -> str:
    """The type of a column, as in a schema text."""
    return df.schema[column].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_rows(
    left: DataFrame, right: DataFrame, how: str, id_column: str = ROW_ID, text_column: str | None = None,
) -> DataFrame:
    """Join a table to results by row; ids may be null. ``right`` loses its key columns."""
    id_, hash_ = free_name(left, "__right_id"), free_name(left, "__right_hash")
    right = right.withColumnsRenamed({ROW_ID: id_, ROW_HASH: hash_})
    row_hash = F.xxhash64(left[text_column]) if text_column else left[ROW_HASH]
    same = left[id_column].eqNullSafe(F.col(id_)) & (row_hash == F.col(hash_))
    return left.join(right, same, how).drop(id_, hash_)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that are deleted when the next one is written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch."""

    def run(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInArrow(run, schema)


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits with those of a column's 64-bit hashes set.

    Its size does not depend on the rows: more of them only make it less selective. It is put together by a
    grouped OR, and at most ``2 ** bits / 64`` words come to the driver.
    """
    bit = F.col(column).bitwiseAND((1 << bits) - 1)
    words = df.select(F.shiftright(bit, 6).alias("at"),
                      F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
    bitmap = np.zeros((1 << bits) // 64, np.uint64)
    for at, b in words.groupBy("at").agg(F.bit_or("b")).collect():
        bitmap[at] = np.uint64(b & (2**64 - 1))
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    place = (hashes & np.uint64(len(bitmap) * 64 - 1)).astype(np.int64)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0


def connected_components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component) for all nodes of an undirected graph; the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours move to its smallest
    neighbour, then its smaller neighbours do. Each step is a grouped minimum and a join, and hot nodes lose
    their neighbours in the first rounds; rounds grow with the logarithm of the nodes. Every round is a
    written table.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both if larger else both.where("v < u")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = around.join(least, "u")
        moved = linked.where("v > u" if larger else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            moved = moved.union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, name)
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        pairs = stored(star(star(pairs, larger=True), larger=False), name)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
