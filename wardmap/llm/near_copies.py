"""N-gram Jaccard join: documents whose sets of word shingles are similar, by signature trees.

1. Every document's set of shingles is hashed; equal sets form a class, and classes are compared once.
2. Of a set of n shingles, fewer than p = n - ceil(t n) + 1 can be missing from a set of similarity t. A class
   with p shingles that no other class has is linked with nothing. Shingles are counted over a fixed share of
   all hash values for that, which can only leave more classes in.
3. Among the classes left, shingles are put in order of their frequency. Similar sets share one of their first p
   shingles; the classes that have such a shingle in common form a group with the smallest class as its hub.
4. Within the group of a hub a signature tree finds the links. A group larger than a block is cut into blocks:
   each is searched together with the hub, and then only classes that are not linked to the hub are taken to the
   other blocks. So a large group of copies costs one comparison per member, not one per pair.
5. Links are joined into components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardmap.llm import arrays, signature_tree
from wardmap.llm.keys import (
    ROW_HASH, ROW_ID, bitmap_of, by_batch, connected_components, free_name, in_bitmap, join_rows, keyed, type_of,
)
from wardmap.session import stored

SHINGLE = 3
#: Least similarity, as a fraction.
SIMILARITY = (90, 100)
BITMAP_BITS = 24
#: Shingles of a block that one task searches.
BLOCK = 1_000_000


def shingles(texts: arrays.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles; a text of fewer than ``k`` words is one shingle."""
    spans = arrays.find_spans(texts, arrays.SPACED)
    hashes, row, counts = arrays.span_hashes(texts, spans, arrays.LOWERED), spans.row, spans.counts
    whole = arrays.whole_rows(row, k)
    rows, values = [row[:len(whole)][whole]], [arrays.gram_hashes(hashes, k)[whole]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            values.append(arrays.gram_hashes(hashes, n)[spans.first[short]])
    row, value = np.concatenate(rows), np.concatenate(values)
    _, first = np.unique(arrays.mix(value ^ arrays.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
    return row[first], value[first]


def sums_by(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, place, values)
    return total


def prefix(size: str | Column, num: int, den: int) -> Column:
    """p of the module's text, for a column of sizes."""
    size = F.col(size) if isinstance(size, str) else size
    return size - F.ceil(size * num / F.lit(den)) + 1


SETS = f"{ROW_HASH} bigint, size bigint, class bigint, counted array<bigint>"


def set_rows(docs: DataFrame, id_column: str, text_column: str, k: int, share: float) -> DataFrame:
    """Size, class and counted shingles (a ``share`` of all hash values) of each row's set.

    A class is the 64-bit sum of its mixed shingles and its size; null for an empty set. Within an Arrow batch,
    equal sets carry their shingles once.
    """
    below = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def run(batches):
        for batch in batches:
            sizes, classes, counted, counts = [], [], [], []
            seen = np.zeros(0, np.uint64)
            for _, texts in arrays.text_slices(batch.column("__text")):
                row, value = shingles(texts, k)
                n = np.bincount(row, minlength=texts.rows)
                name = class_names(row, value, n)
                _, first = np.unique(name, return_index=True)
                new = np.zeros(texts.rows, bool)
                new[first] = True
                new &= ~np.isin(name, seen)
                seen = np.concatenate([seen, name[new]])
                use = new[row] & (arrays.mix(value ^ np.uint64(0xD6E8FEB86659FD93)) <= below)
                order = np.argsort(row[use], kind="stable")
                sizes.append(n)
                classes.append(pa.array(name.view(np.int64), mask=n == 0))
                counted.append(value[use][order])
                counts.append(np.bincount(row[use], minlength=texts.rows))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW_ID), batch.column(ROW_HASH), pa.array(np.concatenate(sizes).astype(np.int64)),
                     pa.concat_arrays(classes),
                     arrays.list_column(pa.array(np.concatenate(counted).view(np.int64)), np.concatenate(counts))],
                    [ROW_ID, ROW_HASH, "size", "class", "counted"])

    return keyed(docs, id_column, text_column).mapInArrow(run, f"{ROW_ID} {type_of(docs, id_column)}, {SETS}")


def class_names(row: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return arrays.mix(sums_by(arrays.mix(value), row, len(sizes)) + sizes.astype(np.uint64))


def passing(rows: DataFrame, bitmap) -> DataFrame:
    """Keyed rows whose text hash has its bit set."""
    return by_batch(
        rows, lambda b: b.filter(pa.array(in_bitmap(bitmap.value, b.column(ROW_HASH).to_numpy().view(np.uint64)))),
        f"{ROW_ID} {type_of(rows, ROW_ID)}, {ROW_HASH} bigint, __text string")


def all_shingles(texts: DataFrame, k: int) -> DataFrame:
    """(class, size, shingle) for all shingles of (class, size, ``__text``)."""

    def run(batches):
        for batch in batches:
            for start, texts in arrays.text_slices(batch.column("__text")):
                row, value = shingles(texts, k)
                at = pa.array(row + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").take(at), batch.column("size").take(at), pa.array(value.view(np.int64))],
                    ["class", "size", "shingle"])

    return texts.select("class", "size", "__text").mapInArrow(run, "class bigint, size bigint, shingle bigint")


def group_links(groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes, from rows with group columns g1, g2, g3, class, label and ``__text``.

    Rows of a group stand together; a class that comes twice counts once.
    """

    def search(names: list, labels: list, texts: list):
        sets, kept, known = [], [], set()
        for name, label, text in zip(names, labels, texts, strict=True):
            for i, (c, own) in enumerate(zip(name, label, strict=True)):
                if c not in known:
                    known.add(c)
                    kept.append((c, own))
                    column = pa.concat_arrays([text.slice(i, 1)])
                    sets.append(np.sort(shingles(next(arrays.text_slices(column, 1 << 62))[1], k)[1]))
        found = signature_tree.links(sets, np.array([own for _, own in kept]), num, den)
        return [(kept[i][0], kept[j][0]) for i, j in found]

    def run(batches):
        current, names, labels, texts = None, [], [], []
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(g).to_pylist() for g in ("g1", "g2", "g3")), strict=True))
            start = 0
            for stop in range(1, len(keys) + 1):
                if stop < len(keys) and keys[stop] == keys[start]:
                    continue
                if keys[start] != current:
                    if len(names) > 1 or names and len(names[0]) > 1:
                        out += search(names, labels, texts)
                    current, names, labels, texts = keys[start], [], [], []
                part = batch.slice(start, stop - start)
                names.append(part.column("class").to_pylist())
                labels.append(part.column("label").to_pylist())
                # Copied, so that a group does not hold on to whole batches.
                texts.append(pa.concat_arrays([part.column("__text")]))
                start = stop
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        if names:
            out = search(names, labels, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    together = groups.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "class")
    return together.select("g1", "g2", "g3", "class", "label", "__text").mapInArrow(run, "a bigint, b bigint")


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK,
) -> DataFrame:
    """One row per document row: key, ``size`` of its set, ``class`` and ``component`` (smallest id reachable).

    A null, empty or blank text has an empty set and is linked with nothing: its class is null and its
    component is its own id. Equal sets are linked whatever their ids, repeated rows too. Null ids take part and
    are passed over as smallest id; a component of null ids only is null. An empty table gives an empty result.
    """
    num, den = similarity
    spark = docs.sparkSession
    # Most classes have more unique shingles among these than they may miss.
    share = min(1.0, 2.5 * (den - num) / den)
    rows = stored(set_rows(docs, id_column, text_column, shingle, share), "sets")
    # One row of each class, the one with the smallest id, and that id.
    classes = stored(rows.where("class is not null").groupBy("class").agg(
        F.min(F.struct(F.col(ROW_ID).isNull().alias("none"), F.col(ROW_ID).alias("id"), F.col(ROW_HASH).alias("hash")))
        .alias("first"), F.max("size").alias("size")), "classes")

    counted = rows.where("size(counted) > 0").select("class", F.explode("counted").alias("shingle"))
    single = counted.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("last")).where(
        "class = last")
    # Dealt out by class before they are counted: a class has few of them in any one task.
    single = single.select("class").repartition("class").groupBy("class").agg(F.count("*").alias("single"))
    left = classes.join(single, "class", "left").where(F.coalesce("single", F.lit(0)) < prefix("size", num, den))
    left = stored(left.select("class", "size", F.col("first.id").alias(ROW_ID), F.col("first.hash").alias(ROW_HASH)),
                  "left")
    # A bitmap of fixed size keeps most other texts from being moved.
    bitmap = spark.sparkContext.broadcast(bitmap_of(left, ROW_HASH, BITMAP_BITS))
    texts = stored(join_rows(passing(keyed(docs, id_column, text_column), bitmap), left, "inner").dropDuplicates(["class"]).select(
        "class", "size", "__text"), "left-texts")

    groups = hub_groups(stored(all_shingles(texts, shingle), "shingles"), num, den)
    totals = groups.join(left.select("class", "size"), "class").groupBy("hub").agg(
        F.ceil(F.sum("size") / block).alias("blocks"))
    members = stored(groups.join(totals, "hub").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))),
                     "members")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    hubs = members.where("blocks > 1 and class = hub").withColumn("block", everywhere)
    placed = members.where("blocks = 1 or class <> hub").unionByName(hubs).join(texts, "class")
    links = stored(group_links(placed.selectExpr(
        "hub g1", "block g2", "0L g3", "class", "class label", "__text"), shingle, num, den), "links")
    large = members.where("blocks > 1")
    if large.limit(1).count():
        links = links.union(far_links(texts, large, links, block, shingle, num, den))

    joined = connected_components(links, "a", "b", "components")
    reached = classes.join(joined, classes["class"] == joined["node"]).select("class", "component", "first.id")
    smallest = reached.groupBy("component").agg(F.min("id").alias("smallest"))
    reached = reached.drop("id").join(smallest, "component").drop("component")
    # Written, so that a class with many rows is a skewed key of this join alone, which Spark splits.
    found = stored(classes.join(reached, "class", "left").select(
        "class", F.coalesce("smallest", "first.id").alias("component")), "class-components")
    return rows.drop("counted").join(found, "class", "left").withColumn(
        "component", F.when(F.col("class").isNull(), F.col(ROW_ID)).otherwise(F.col("component")))


def hub_groups(shingle_rows: DataFrame, num: int, den: int) -> DataFrame:
    """(class, hub): classes that have one of their first shingles in common, in order of frequency.

    Shingles of one class alone come first and find nothing, so only shared ones are put in order.
    """
    # Written, as are the hubs, so that a frequent shingle is a skewed key of a join alone, which Spark splits.
    often = stored(shingle_rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    shared = shingle_rows.join(often, "shingle")
    by_class = Window.partitionBy("class")
    placed = shared.select(
        "class", "size", "shingle", F.row_number().over(by_class.orderBy("often", "shingle")).alias("place"),
        F.count("*").over(by_class).alias("shared"))
    first = stored(placed.where(F.col("place") + F.col("size") - F.col("shared") <= prefix("size", num, den)).select(
        "class", "shingle"), "first-shingles")
    hubs = first.groupBy("shingle").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub <> last")
    return first.join(stored(hubs.drop("last"), "hubs"), "shingle").select("class", "hub").distinct()


def far_links(texts: DataFrame, members: DataFrame, links: DataFrame, block: int, k: int, num: int, den: int):
    """Links between blocks of large groups: of the classes that are not linked to their hub, to all others.

    Before texts move, the members of a hub are put into ranges of sizes, the next of which begins at ``den / num`` of
    the last. Sets two ranges apart cannot be similar, so a class goes only to the blocks of its own range and its
    neighbours, in which the tree's bounds prune the rest.
    """
    joined = connected_components(links, "a", "b", "near")
    own = members.join(joined, members["class"] == joined["node"], "left").select(
        "hub", "class", F.coalesce("component", "class").alias("label"))
    main = own.where("class = hub").select("hub", F.col("label").alias("main"))
    own = own.join(main, "hub").withColumn("apart", F.col("label") != F.col("main"))
    reach = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num)) + 1e-9).cast("long")
    own = stored(own.join(texts.select("class", "size"), "class").withColumn("range", reach), "labels")
    # Few rows: one for each range of a hub.
    ranges = stored(own.groupBy("hub", "range").agg(
        F.ceil(F.sum("size") / block).alias("blocks"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("apart"), F.col("size"))), F.lit(0)) / block).alias("bins")), "ranges")
    near = ranges.select("hub", F.col("range").alias("other"), F.col("blocks").alias("all_blocks"),
                         F.col("bins").alias("all_bins"))
    around = F.explode(F.array(*[F.col("range") + i for i in (-1, 0, 1)]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("class", "hub"), F.col(n))
    key = lambda a, n: F.shiftleft(F.col(a), 32) + F.col(n)
    placed = own.join(ranges, ["hub", "range"])
    fixed = placed.withColumn("block", part("blocks")).withColumn("other", around).join(near, ["hub", "other"]).where(
        "all_bins > 0").withColumn("bin", every("all_bins")).select(
        F.col("hub").alias("g1"), key("range", "block").alias("g2"), key("other", "bin").alias("g3"), "class", "label")
    moved = placed.where("apart").withColumn("bin", part("bins")).withColumn("other", around).join(
        near, ["hub", "other"]).withColumn("block", every("all_blocks")).select(
        F.col("hub").alias("g1"), key("other", "block").alias("g2"), key("range", "bin").alias("g3"), "class", "label")
    return stored(group_links(fixed.union(moved).distinct().join(texts, "class"), k, num, den), "far-links")


def near_copy_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id for each document row."""
    return near_copies(docs, **options).select(
        F.col(ROW_ID).alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def without_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options,
) -> DataFrame:
    """One document of each group, the one with the smallest id (then hash of the text), all columns as given.

    Documents without words are all kept. Of rows equal in id and text one is kept.
    """
    found = stored(near_copies(docs, id_column, text_column, **options), "near-copies")
    grouped = found.where("class is not null").groupBy(F.coalesce("component", "class").alias("group")).agg(
        F.min(F.struct(F.col(ROW_ID).isNull().alias("none"), F.col(ROW_ID).alias("id"), F.col(ROW_HASH).alias("hash")))
        .alias("first"))
    kept = grouped.select(F.col("first.id").alias(ROW_ID), F.col("first.hash").alias(ROW_HASH))
    times = free_name(docs, "__rows")
    counts = found.where("class is not null").groupBy(ROW_ID, ROW_HASH).agg(F.count("*").alias(times))
    kept = join_rows(kept, counts, "inner").unionByName(
        found.where("class is null").select(ROW_ID, ROW_HASH, F.lit(1).cast("long").alias(times)).distinct())
    rows = join_rows(docs, stored(kept, "kept"), "inner", id_column, text_column)
    repeated = rows.where(F.col(times) > 1).dropDuplicates([id_column, text_column])
    return rows.where(F.col(times) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
