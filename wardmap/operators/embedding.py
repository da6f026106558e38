"""Dense vectors of facility text: latent semantic projection found by a randomised range finder.

Texts become unit TF-IDF vectors over ``slots`` hashed terms. Their leading right singular vectors are found by
multiplying a random matrix with the rows' Gram matrix, block by block: each task sums ``a (a . S)`` over its rows, Spark
adds the blocks up, and the small result is made orthonormal before the next pass. What the driver holds has ``slots``
rows of ``size`` and a few numbers, whatever the number of facilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lists import tokens
from ..functions.values import hash_slot
from ..session import stored
from ..sources.tables import KEY

#: Numbers of an embedding.
SIZE = 384
SLOTS = 1 << 12
#: Columns beyond ``SIZE`` that the range finder carries, and its passes over the rows.
SPARE, PASSES = 16, 3
#: Rows that a task multiplies at a time, and tasks a core, at most, that each give a sum for nearly every slot.
ROWS, TASKS = 512, 4


@dataclass
class TextModel:
    """A fitted projection: weights of the slots (``idf``) and an orthonormal basis, a row for each slot."""

    idf: np.ndarray
    basis: np.ndarray

    def vectors(self, batch: pa.RecordBatch) -> np.ndarray:
        """Vectors of a batch's ``slots`` and ``weights`` as a matrix: unit length, or zeros without a known direction."""
        result, start = np.zeros((batch.num_rows, self.basis.shape[1])), 0
        for some, used, dense in blocks(iter([batch])):
            m = dense @ self.basis[used]
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            result[start:start + some.num_rows] = m / np.where(norm > 1e-12, norm, np.inf)
            start += some.num_rows
        return result


def slot_counts(parts: DataFrame, key: str, slots: int) -> DataFrame:
    """key, slot and how often its terms stand in the texts of the key."""
    return parts.select(key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(
        key, hash_slot(F.col("term"), slots).cast("int").alias("slot")).agg(F.count("*").alias("tf"))


def weighted(counts: DataFrame, idf: np.ndarray, key: str) -> DataFrame:
    """key, slots and weights: the unit TF-IDF vector of each key, at most a number for each slot."""
    table = counts.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(idf)], "slot int, idf double")
    # A row for each slot.
    rows = counts.join(F.broadcast(table), "slot").select(key, "slot", (F.col("tf") * F.col("idf")).alias("weight"))
    norm = F.nullif(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct("slot", "weight")))
    return rows.groupBy(key).agg(listed.alias("e"), norm.alias("norm")).select(
        key, F.transform("e", lambda x: x["slot"]).alias("slots"),
        F.transform("e", lambda x: F.coalesce(x["weight"] / F.col("norm"), F.lit(0.0))).alias("weights"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of a few rows with the slots they use and their weights as a dense matrix over these."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            slots = batch.column("slots").flatten().to_numpy(zero_copy_only=False)
            values = batch.column("weights").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column("slots").value_lengths().to_numpy(zero_copy_only=False))
            used, place = np.unique(slots, return_inverse=True)
            dense = np.zeros((batch.num_rows, len(used)))
            dense[row, place] = values
            yield batch, used, dense


def gram_product(rows: DataFrame, matrix: np.ndarray) -> np.ndarray:
    """Sum over all rows ``a`` of ``a (a . matrix)``, a row for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(matrix)
        for _, used, dense in blocks(batches):
            total[used] += dense.T @ (dense @ matrix[used])
        touched = np.flatnonzero(total.any(1))
        for start in range(0, len(touched), 1_000):
            some = touched[start:start + 1_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]))], ["slot", "sums"])

    few = rows.select("slots", "weights").coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "slot int, sums array<double>")
    sums = parts.groupBy("slot").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).select("slot", vector_to_array("s"))
    result, table = np.zeros_like(matrix), sums.toArrow()
    if table.num_rows:
        values = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        result[table.column(0).to_numpy()] = values.reshape(table.num_rows, -1)
    return result


def fit_text_model(
    parts: DataFrame, size: int = SIZE, slots: int = SLOTS, key: str = KEY, passes: int = PASSES, seed: int = 5,
) -> tuple[TextModel, DataFrame]:
    """The projection of the texts (key, text) of all keys, and their unit TF-IDF vectors (key, slots, weights)."""
    counts = stored(slot_counts(parts, key, slots), "slot-counts")
    total = counts.agg(F.count_distinct(key)).first()[0]
    idf = np.full(slots, np.log(total + 1.0))
    # A row for each slot.
    for slot, n in counts.groupBy("slot").agg(F.count("*")).collect():
        idf[slot] = np.log((total + 1.0) / (n + 1.0))
    rows = stored(weighted(counts, idf, key), "slot-weights")
    width = min(size + SPARE, slots)
    matrix = np.linalg.qr(np.random.default_rng(seed).standard_normal((slots, width)))[0]
    for _ in range(passes):
        matrix = np.linalg.qr(gram_product(rows, matrix))[0]
    # The best directions within the range that was found, strongest first.
    small = matrix.T @ gram_product(rows, matrix)
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    return TextModel(idf, matrix @ turn[:, np.argsort(-strength)[:size]]), rows


def projected(rows: DataFrame, model: TextModel, key: str = KEY) -> DataFrame:
    """key and ``embedding``, of unit length (zeros for texts without a known direction)."""
    schema = T.StructType([rows.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(model.vectors(batch)), pa.list_(pa.float64()))], schema.names)

    return rows.select(key, "slots", "weights").mapInArrow(run, schema)


def embedded(texts: DataFrame, model: TextModel, key: str) -> DataFrame:
    """key and ``embedding`` of other texts (key, text), such as questions; texts without a term have no row."""
    return projected(weighted(slot_counts(texts, key, len(model.idf)), model.idf, key), model, key)


def embed_facilities(
    parts: DataFrame, key: str = KEY, coded: bool = False, **options,
) -> tuple[DataFrame, TextModel]:
    """key and ``embedding`` of every key; and the fitted model.

    With ``coded`` the embeddings stay as slots and weights, a written table of a fraction of their bytes, for readers
    that take the vectors of a batch from the model.
    """
    model, rows = fit_text_model(parts, key=key, **options)
    return (rows if coded else projected(rows, model, key)), model


def write_model(model: TextModel, spark: SparkSession, path: str) -> None:
    """A row for each slot."""
    basis = pa.FixedSizeListArray.from_arrays(pa.array(model.basis.reshape(-1)), model.basis.shape[1])
    table = pa.table({"slot": pa.array(range(len(model.idf)), pa.int32()), "idf": pa.array(model.idf),
                      "directions": basis.cast(pa.list_(pa.float64()))})
    spark.createDataFrame(table).coalesce(1).write.parquet(path)


def read_model(spark: SparkSession, path: str) -> TextModel:
    """A model written before."""
    slots = sorted(spark.read.parquet(path).collect())
    return TextModel(np.array([s.idf for s in slots]), np.array([s.directions for s in slots]))
