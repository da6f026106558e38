"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size. Within each source, documents are
put in order of size and id, expected copies are summed up, one random offset is added, and a document is
emitted once for every integer the running sum crosses on it. Equal sizes stand together, so the words taken
miss the target by about one document's size at most, and no document is taken more often than its expected
copies rounded up.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardmap.llm.keys import free_name
from wardmap.session import stored

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240607


def offset_of(seed: int) -> float:
    """The random offset in [0, 1)."""
    return random.Random(seed).random()


def running(df: DataFrame, within: list[str], order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Add ``__rank`` and running sums (``sums``: new name -> column) within groups.

    Rows are dealt out by ranges of the order, so a group of any size spreads over all tasks. Each task numbers
    its own rows; the totals of earlier ranges, one row for each range and group, are added. The result does
    not depend on where the ranges end.
    """
    columns = df.columns
    ranges = stored(df.repartitionByRange(*within, *order).withColumn("__part", F.spark_partition_id()), name)
    totals = ranges.groupBy(*within, "__part").agg(
        F.count("*").alias("__n"), *[F.sum(c).alias(f"__before_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__n", *[f"__before_{k}" for k in sums]]
    totals = totals.select(*within, "__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names])
    own = Window.partitionBy(*within, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranges.select(
        *columns, "__part", F.row_number().over(Window.partitionBy(*within, "__part").orderBy(*order)).alias("__i"),
        *[F.sum(c).over(own).alias(k) for k, c in sums.items()])
    return numbered.join(totals, [*within, "__part"]).select(
        *columns, (F.col("__n") + F.col("__i")).alias("__rank"),
        *[(F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: ``__source``, its number, ``__source_size`` and ``__target``.

    ``sizes`` holds ``__source`` and ``__size`` per document. Sources in code point order, null last, get the
    weights in turn. They share ``share`` of all sizes by weight, but none gets more than ``most`` times its
    size; what is over is shared again. With sources by rising limit per weight, the ones before the first
    that stays under its limit are full, and what they leave is shared evenly by weight.
    """
    sources = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    ranked = running(sources, [], [F.col("__source").asc_nulls_last()], {}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") - 1).cast("int") % len(weights) + 1)
    ranked = ranked.withColumn("__weight", weight.cast("long")).withColumnRenamed("__rank", "__number").withColumn(
        "__most", most * F.col("__source_size")).withColumn("__limit", F.col("__most") / F.col("__weight"))
    filled = stored(running(ranked, [], [F.col("__limit").asc(), F.col("__number").asc()],
                            {"__used": "__most", "__weights": "__weight"}, "limits"), "targets")
    total = filled.agg(F.sum("__source_size").alias("size"), F.sum("__weight").alias("weight")).first()
    if total["size"] is None:
        return filled.select("__source", "__number", "__source_size", F.lit(0.0).alias("__target"))
    left = F.lit(share * total["size"]) - (F.col("__used") - F.col("__most"))
    level = left / (total["weight"] - F.col("__weights") + F.col("__weight"))
    even = filled.select(level.alias("level"), "__limit").where("level <= __limit").agg(F.max("level")).first()[0]
    target = F.least(F.col("__weight") * F.lit(float(even)), F.col("__most").cast("double"))
    return filled.select("__source", "__number", "__source_size", target.alias("__target"))


def drawn(sized: DataFrame, seed: int = SEED, **targets) -> DataFrame:
    """Add ``__source_size``, ``__target`` and ``__copies`` to rows with ``__id``, ``__source`` and ``__size``."""
    sized = stored(sized, "sizes")
    sources = source_targets(sized, **targets)
    other = sources.withColumnRenamed("__source", "__of")
    rows = sized.join(other, sized["__source"].eqNullSafe(other["__of"])).drop("__of")
    order = [F.col("__size").asc(), F.col("__id").asc_nulls_last()]
    numbered = running(rows, ["__number"], order, {}, "ranks")
    expected = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    crossed = lambda n: F.floor(F.lit(offset_of(seed)) + expected * n)
    return numbered.withColumn(
        "__copies", (crossed(F.col("__rank")) - crossed(F.col("__rank") - 1)).cast("long")).drop("__rank", "__number")


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs[text_column], F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(docs[id_column].alias("__id"), docs[source_column].alias("__source"), size.alias("__size"),
                       *more)


def mixture_report(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options,
) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document row.

    A null or blank text has size 0. Documents of one source that are equal in size and id (repeated rows) are
    interchangeable: the result has the same rows whichever of them is taken. A source of size 0 has target 0
    and takes nothing. An empty table gives an empty result. Other columns are not read.
    """
    return drawn(sized(docs, id_column, text_column, source_column), **options).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options,
) -> DataFrame:
    """The mixture: every document as often as it is taken, all columns as given.

    Only ids, sizes and a hash of each row are ordered and numbered; the texts are joined to the result. Rows
    equal in all columns are written once and repeated as often as all of them are taken.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    copies = drawn(sized(docs, id_column, text_column, source_column, row.alias("__row")), **options)
    id_, row_, times, rows, copy = (free_name(docs, f"__{n}") for n in ("mix_id", "mix_row", "mix_times", "mix_rows", "mix_copy"))
    copies = copies.groupBy("__id", "__row").agg(F.sum("__copies").alias(times), F.count("*").alias(rows))
    copies = copies.where(F.col(times) > 0).withColumnsRenamed({"__row": row_, "__id": id_})
    same = docs[id_column].eqNullSafe(F.col(id_)) & (row == F.col(row_))
    found = stored(docs.join(copies, same).drop(id_, row_), "mixture")
    once = found.where(F.col(rows) == 1).unionByName(found.where(F.col(rows) > 1).dropDuplicates())
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
