"""Benchmark decontamination by winnowing.

Words are ASCII letters and digits and everything beyond ASCII, A-Z folded. A window is ``window`` consecutive
words of a benchmark item; an item of fewer words is one window of its own length. Of the word k-grams of each
window the smallest hash is kept (k = ``gram``, or the window if that is shorter), so a document and an item
that share a window keep the same k-gram at the same place in it. The kept k-grams are joined; a hit is then
extended to the windows around it by comparing their hashes, which finds every shared window and no other.

Documents only pass on k-grams whose bit is set in a bitmap of the benchmark's k-grams. The bitmap has a fixed
size whatever the benchmark's (more items only make it less selective); it is the one thing sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm import arrays
from wardmap.llm.keys import ROW_HASH, ROW_ID, bitmap_of, by_batch, in_bitmap, join_rows, keyed, type_of
from wardmap.session import stored

SALTS = 16
ANCHORS = "array<struct<size: int, gram: bigint, place: bigint, windows: array<bigint>>>"


def kept_grams(hashes: np.ndarray, row: np.ndarray, size: int, gram: int, bitmap: np.ndarray | None):
    """(k-gram hashes, their places, hashes of the windows that hold them) for windows of ``size`` words.

    Of a window's equal smallest hashes the last is kept. A k-gram at place p lies in the windows that begin
    from ``p - (size - k)`` to ``p``; those beyond the text are 0.
    """
    k = min(gram, size)
    reach = size - k + 1
    grams = arrays.gram_hashes(hashes, k, seed=size << 8)
    windows = arrays.gram_hashes(hashes, size, seed=1 << 20)
    inside = arrays.whole_rows(row, size)
    windows[~inside | (windows == 0)] = 1
    n = len(windows)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, reach):
        step = grams[j:j + n]
        lower = step <= least
        least[lower] = step[lower]
        at[lower] = j
    kept = np.zeros(len(grams), bool)
    kept[(np.arange(n) + at)[inside]] = True
    places = np.flatnonzero(kept)
    if bitmap is not None:
        places = places[in_bitmap(bitmap, grams[places])]
    starts = places[:, None] + np.arange(1 - reach, 1)
    ok = (starts >= 0) & (starts < n)
    starts[~ok] = 0
    ok &= inside[starts] if n else False
    around = np.where(ok, windows[starts], np.uint64(0)) if n else np.zeros(starts.shape, np.uint64)
    return grams[places], places, around


def anchors_of(batch: pa.RecordBatch, sizes, gram: int, window: int, bitmap: np.ndarray | None) -> pa.RecordBatch:
    """Word count and kept k-grams of each row. Without ``sizes`` a row's own length, up to ``window``, is used."""
    n_words, counts, parts = [], [], []
    for _, texts in arrays.text_slices(batch.column("__text")):
        spans = arrays.find_spans(texts, arrays.ALPHANUMERIC)
        words = spans.counts
        n_words.append(words)
        hashes, row = arrays.span_hashes(texts, spans, arrays.LOWERED), spans.row
        own = np.minimum(words, window)
        found_row, found = [], []
        for size in sizes if sizes is not None else np.unique(own[own > 0]):
            size = int(size)
            grams, places, around = kept_grams(hashes, row, size, gram, bitmap)
            of = row[places]
            if sizes is None:
                use = own[of] == size
                grams, places, around, of = grams[use], places[use], around[use], of[use]
            found_row.append(of)
            found.append((np.full(len(of), size, np.int32), grams, places - spans.first[of], around))
        of = np.concatenate(found_row) if found_row else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        counts.append(np.bincount(of, minlength=texts.rows))
        size = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
        grams = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        places = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        widths = np.concatenate([np.full(len(f[0]), f[3].shape[1]) for f in found]) if found else np.zeros(0, int)
        values = np.concatenate([f[3].ravel() for f in found]) if found else np.zeros(0, np.uint64)
        around = arrays.list_column(pa.array(values.view(np.int64)), widths).take(pa.array(order))
        parts.append(pa.StructArray.from_arrays(
            [pa.array(size[order]), pa.array(grams[order].view(np.int64)), pa.array(places[order]), around],
            ["size", "gram", "place", "windows"]))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    empty = pa.StructArray.from_arrays(
        [pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64()),
         pa.array([], pa.list_(pa.int64()))], ["size", "gram", "place", "windows"])
    return pa.RecordBatch.from_arrays(
        [batch.column(ROW_ID), batch.column(ROW_HASH), pa.array(joined(n_words).astype(np.int64)),
         arrays.list_column(pa.concat_arrays(parts) if parts else empty, joined(counts))],
        [ROW_ID, ROW_HASH, "__n_words", "__anchors"])


SCHEMA = f"{ROW_HASH} bigint, __n_words bigint, __anchors {ANCHORS}"


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", window: int = 10, gram: int = 5,
    bitmap_bits: int = 24,
) -> DataFrame:
    """One row per document row: key, ``__n_words``, ``__spans`` (start, words; sorted) and ``__items``.

    Spans are all occurrences of windows, so they overlap; ``__items`` are the distinct ids of items with a
    window in the text. A null or wordless text has no words and no spans. Items without words match nothing;
    a null item id marks spans but is not listed. Rows equal in id and text get equal results, one row each.
    Empty tables give an empty result or no spans. Other columns are not read.
    """
    spark = docs.sparkSession
    item_type = type_of(items, item_id_column)
    source = stored(by_batch(
        keyed(items, item_id_column, item_text_column),
        lambda b: anchors_of(b, None, gram, window, None), f"{ROW_ID} {item_type}, {SCHEMA}").where("__n_words > 0"), "windows")
    theirs = source.select(F.col(ROW_ID).alias("item"), F.explode("__anchors").alias("a")).select(
        "item", "a.size", "a.gram", "a.windows")
    # At most ``window`` sizes.
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect())
    bitmap = bitmap_of(theirs, "gram", bitmap_bits)
    sent = spark.sparkContext.broadcast(bitmap)
    rows = stored(by_batch(
        keyed(docs, id_column, text_column), lambda b: anchors_of(b, sizes, gram, window, sent.value),
        f"{ROW_ID} {type_of(docs, id_column)}, {SCHEMA}"),
        "fingerprints")

    salt = F.pmod(F.xxhash64(ROW_ID, ROW_HASH), F.lit(SALTS))
    ours = rows.select(ROW_ID, ROW_HASH, salt.alias("salt"), F.explode("__anchors").alias("a")).select(
        ROW_ID, ROW_HASH, "salt", "a.size", "a.gram", "a.place", F.col("a.windows").alias("around"))
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
        "salt", F.col("salt").cast("long"))
    matched = F.zip_with("around", "windows", lambda x, y: (x == y) & (x != 0))
    hits = ours.join(theirs, ["size", "gram", "salt"]).select(
        ROW_ID, ROW_HASH, "item", "size", "place", F.posexplode(matched).alias("j", "hit")).where("hit").select(
        ROW_ID, ROW_HASH, "item",
        F.struct((F.col("place") + F.col("j") - F.greatest(F.col("size") - gram, F.lit(0))).alias("start"),
                 F.col("size").alias("words")).alias("span"))
    # Both sets are bounded by one document: its words, and the items it holds.
    per_row = hits.groupBy(ROW_ID, ROW_HASH).agg(
        F.array_sort(F.collect_set("span")).alias("__spans"), F.array_sort(F.collect_set("item")).alias("__items"))
    return join_rows(rows.drop("__anchors"), per_row, "left").select(
        ROW_ID, ROW_HASH, "__n_words",
        F.coalesce("__spans", F.expr("cast(array() as array<struct<start: bigint, words: int>>)")).alias("__spans"),
        F.coalesce("__items", F.array().cast(f"array<{item_type}>")).alias("__items"))


def covered(spans: str):
    """Words inside any of the sorted spans."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["words"]).alias("end"),
            (s["total"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["words"] - F.greatest(s["end"], x["start"])))
            .alias("total")))
    return step["total"]


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each document row."""
    ids = F.array_join(F.array_sort(F.transform("__items", lambda x: x.cast("string"))), ",")
    return contamination(docs, items, **options).select(
        F.col(ROW_ID).alias("doc_id"), F.col("__n_words").alias("n_words"), covered("__spans").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.size("__spans") > 0).alias("contaminated"))


def without_contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 1,
    **options,
) -> DataFrame:
    """The documents that share no window of at least ``least_words`` words with any item, all columns as given.

    Windows are shorter than the usual ones only where an item is: a whole item of one or a few words says nothing
    about the document that holds it.
    """
    found = contamination(docs, items, id_column, text_column, **options).where(
        F.exists("__spans", lambda span: span["words"] >= least_words))
    found = found.select(ROW_ID, ROW_HASH).distinct()
    return join_rows(docs, found, "left_anti", id_column, text_column)
