"""Quality rules: counts over whole texts, and a trained classifier of hashed n-grams.

Words are runs of anything but ASCII white space. The classifier sees hashed words, word pairs and runs of
three characters, each family as shares of the text, so length does not matter. It is a logistic regression
fitted on a bounded sample of the labelled rows and calibrated on held-out ones; texts are scored in Arrow
batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm import arrays, logistic
from wardmap.llm.keys import free_name, type_of

#: Labelled rows of each class that the classifier is fitted on.
SAMPLE = 2000
BITS = 17
FAMILIES = 3
STRENGTH = 30.0
#: Rule thresholds: fewer words fail; more per cent of words in repeated three-word windows fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Least calibrated probability of good quality.
LEAST_GOOD = 0.5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


class Model(NamedTuple):
    """Weights of the hashed features, bias, and the calibration's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct_per_row(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    _, where = np.unique(keys, return_index=True)
    return np.bincount(row[where], minlength=rows)


def rule_counts(texts: arrays.Texts, spans: arrays.Spans, hashes: np.ndarray) -> list[np.ndarray]:
    """The counts named in ``COUNTS`` for each text."""
    solid = arrays.SPACED[texts.data]
    chars = solid & ((texts.data & 0xC0) != 0x80)
    lines = arrays.find_lines(texts)
    filled = np.concatenate([[0], np.cumsum(solid)])
    worded = filled[lines.ends] > filled[lines.starts]
    row = lines.row[worded]
    keys = arrays.span_hashes(texts, lines)[worded]
    keys = arrays.mix(keys ^ arrays.mix(row.astype(np.uint64) + np.uint64(1)))
    doubled = np.bincount(row, minlength=texts.rows) - distinct_per_row(keys, row, texts.rows)

    row = spans.row
    whole = arrays.whole_rows(row, 3)
    grams = arrays.gram_hashes(hashes, 3)
    grams = arrays.mix(grams ^ arrays.mix(row[:len(grams)].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(grams[whole])
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeated = np.zeros(len(row) + 1, bool)
    if len(again):
        place = np.minimum(np.searchsorted(again, grams), len(again) - 1)
        at = np.flatnonzero((again[place] == grams) & whole)
        for j in range(3):
            repeated[at + j] = True
    return [spans.counts, per_row(chars, texts.offsets), per_row(SYMBOLS[texts.data], texts.offsets), doubled,
            np.bincount(row, weights=repeated[:-1], minlength=texts.rows).astype(np.int64)]


def features(texts: arrays.Texts, spans: arrays.Spans, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) of every word, word pair and run of three characters."""
    shift = np.uint64(64 - BITS)
    row = spans.row
    for n in (1, 2):
        whole = arrays.whole_rows(row, n)
        columns = (arrays.gram_hashes(hashes, n, seed=n) >> shift).astype(np.int64)
        yield row[:len(columns)][whole], columns[whole] + ((n - 1) << BITS)
    starts = np.flatnonzero((texts.data & 0xC0) != 0x80)
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(texts.rows), np.diff(np.searchsorted(starts, texts.offsets)))
    whole = arrays.whole_rows(row, 3)
    columns = (arrays.gram_hashes(codes, 3, seed=3) >> shift).astype(np.int64)
    yield row[:len(columns)][whole], columns[whole] + (2 << BITS)


def probability(model: Model, texts: arrays.Texts, spans: arrays.Spans, hashes: np.ndarray) -> np.ndarray:
    z = np.full(texts.rows, model.bias)
    for row, columns in features(texts, spans, hashes):
        total = np.bincount(row, weights=model.weights[columns], minlength=texts.rows)
        z += STRENGTH * total / np.maximum(1, np.bincount(row, minlength=texts.rows))
    return logistic.probabilities(model.slope * z + model.shift)


def sample_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sparse feature rows of labelled texts."""
    columns, values, counts = [], [], []
    for _, texts in arrays.text_slices(batch.column("__text")):
        spans = arrays.find_spans(texts, arrays.SPACED)
        hashes = arrays.span_hashes(texts, spans)
        keys, shares = [], []
        for row, column in features(texts, spans, hashes):
            key, n = np.unique(row << (BITS + 2) | column, return_counts=True)
            keys.append(key)
            shares.append(STRENGTH * n / np.bincount(row, minlength=texts.rows)[key >> (BITS + 2)])
        key, share = np.concatenate(keys), np.concatenate(shares)
        order = np.argsort(key)
        columns.append((key[order] & ((1 << (BITS + 2)) - 1)).astype(np.int32))
        values.append(share[order].astype(np.float32))
        counts.append(np.bincount(key >> (BITS + 2), minlength=texts.rows))
    joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    counts = joined(counts, np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column("__id"), batch.column("__label"),
         arrays.list_column(pa.array(joined(columns, np.int32)), counts),
         arrays.list_column(pa.array(joined(values, np.float32)), counts)],
        ["__id", "__label", "columns", "values"])


def fitted(ids: np.ndarray, labels: np.ndarray, x: logistic.Sparse, totals: dict[int, int]) -> Model | None:
    """Fit on four fifths, calibrate on the rest, whose rows count as often as their class is labelled."""
    held = arrays.mix(ids.astype(np.uint64)) % np.uint64(5) == 0
    if any(not (labels[part] == c).any() for part in (held, ~held) for c in (0, 1)):
        return None
    weights, bias = logistic.fit(x.rows(~held), labels[~held], FAMILIES << BITS)
    z, y = logistic.margins(x.rows(held), weights, bias), labels[held]
    weight = {c: totals[c] / (labels == c).sum() for c in (0, 1)}
    slope, shift = logistic.calibrate(z, y, np.where(y == 1, weight[1], weight[0]))
    return Model(weights.astype(np.float32), bias, slope, shift)


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_id_column: str = "doc_id", label_column: str = "quality", sample: int = SAMPLE,
) -> Model | None:
    """The classifier, fitted on at most ``sample`` labelled documents of each class.

    The ones with the smallest hashes of the id are taken. Ids labelled twice with different values, null ids
    and null labels are left out; a document that stands there twice counts once. None if a class is missing.
    Features are made where the texts are; one task fits the bounded sample, and only the weights come back.
    """
    known = labels.select(labels[label_id_column].alias("__id"), labels[label_column].cast("int").alias("__label"))
    known = known.where("__id is not null and __label in (0, 1)").groupBy("__id").agg(
        F.min("__label").alias("__label"), F.max("__label").alias("__top")).where("__label = __top").drop("__top")
    totals = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    parts = [known.where(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample) for c in (0, 1)]
    chosen = parts[0].union(parts[1])
    # At most twice ``sample`` ids and labels.
    texts = docs.select(docs[id_column].alias("__id"), docs[text_column].cast("string").alias("__text")).where(
        "__text is not null").join(F.broadcast(chosen), "__id")

    def extract(batches):
        for batch in batches:
            yield sample_features(batch)

    # Whole numbers stand for the ids: they tell which rows are held out.
    whole = type_of(docs, id_column) in ("tinyint", "smallint", "int", "bigint")
    texts = texts.withColumn("__id", F.col("__id").cast("long") if whole else F.xxhash64("__id"))
    rows = texts.mapInArrow(extract, "__id bigint, __label int, columns array<int>, values array<float>")
    # Of several texts under one id that with the smallest hash counts.
    one = F.min_by(F.struct("__label", "columns", "values"), F.xxhash64("columns", "values")).alias("one")
    rows = rows.groupBy("__id").agg(one).select("__id", "one.*")

    def learn(batches):
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks().sort_by("__id")
        column = lambda name: table.column(name).combine_chunks()
        lists = column("columns")
        x = logistic.Sparse(
            lists.flatten().to_numpy(), column("values").flatten().to_numpy(),
            np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]))
        model = fitted(column("__id").to_numpy(), column("__label").to_numpy(), x, totals)
        if model is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weights], pa.list_(pa.float32())),
                 pa.array([[model.bias, model.slope, model.shift]], pa.list_(pa.float64()))], ["weights", "rest"])

    found = rows.repartition(1).mapInArrow(learn, "weights array<float>, rest array<double>").collect()
    return Model(np.array(found[0]["weights"], np.float32), *found[0]["rest"]) if found else None


def assess(docs: DataFrame, model: Model | None, text_column: str = "text", least_good: float = LEAST_GOOD) -> DataFrame:
    """All columns of ``docs`` and one more, the last: the counts, base_failed, probability and kept.

    A null or blank text has no words, so it fails the rules. Without a model the probability is null and the
    rules decide alone. Texts are scored whole; one text is in memory at a time beyond the Arrow batch.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = f"struct<{COUNTS.replace(' bigint', ': bigint')}, base_failed: boolean, probability: double, kept: boolean>"
    at, name = docs.columns.index(text_column), free_name(docs, "__quality")

    def run(batches):
        for batch in batches:
            parts = []
            for _, texts in arrays.text_slices(batch.column(at)):
                spans = arrays.find_spans(texts, arrays.SPACED)
                hashes = arrays.span_hashes(texts, spans)
                counts = rule_counts(texts, spans, hashes)
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
                if sent.value is None:
                    good = pa.nulls(texts.rows, pa.float64())
                    kept = ~failed
                else:
                    p = probability(sent.value, texts, spans, hashes)
                    good, kept = pa.array(p), ~failed & (p >= least_good)
                names = [c.split()[0] for c in COUNTS.split(", ")]
                parts.append(pa.StructArray.from_arrays(
                    [*[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed), good, pa.array(kept)],
                    [*names, "base_failed", "probability", "kept"]))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.concat_arrays(parts)], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.limit(0).withColumn(name, F.lit(None).cast(kind)).schema)


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept for each document row."""
    model = train(docs, labels, **options)
    rows = assess(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", f"{rows.columns[-1]}.*")


def good_documents(docs: DataFrame, labels: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents that pass the rules and the classifier, all columns as given."""
    rows = assess(docs, train(docs, labels, text_column=text_column, **options), text_column)
    return rows.where(rows[rows.columns[-1]]["kept"]).select(*[rows[c] for c in docs.columns])
