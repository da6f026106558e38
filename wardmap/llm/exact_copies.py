r"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are compared without the characters ``ignored`` (white space). The first read of the texts leaves two fixed-size
marks of each row: the length and a hash of the first ``prefix`` characters. Rows are grouped by length; those of a
repeated length by length and prefix hash; only rows that still have company are hashed in full by a second read. What
tells that read which rows these are is a bitmap of fixed size: as it fills up, more rows are hashed than need be, and
the groups, which are those of equal SHA-256 values, stay the same. Texts are never moved between tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardmap.llm.keys import bitmap_of, in_bitmap
from wardmap.session import stored

#: White space that does not count.
IGNORED = r"[\x20\x09-\x0D]+"
#: Characters of a text's beginning that are hashed first.
PREFIX = 256
#: Size of the bitmap of repeated marks (2 MB).
BITMAP_BITS = 24

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def marks(text: Column, prefix: int) -> list[Column]:
    """Length in bytes and hash of the first characters of a text without its ignored characters."""
    return [F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, prefix)).alias("start")]


def repeated_marks(squeezed: DataFrame, prefix: int, bits: int) -> np.ndarray:
    """Bitmap of the marks that several rows share; ``squeezed`` holds a column ``text``."""
    marked = stored(squeezed.select(*marks(F.col("text"), prefix)), "marks")
    lengths = stored(marked.groupBy("length").count().where("count > 1").select("length"), "lengths")
    again = marked.join(lengths, "length", "left_semi").groupBy("length", "start").count().where("count > 1")
    return bitmap_of(again.select(F.xxhash64("length", "start").alias("mark")), "mark", bits)


def exact_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None,
    digests: bool = False, ignored: str = IGNORED, prefix: int = PREFIX, bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """Every row's ``columns`` (all but the text, unless given) and its group of equal texts.

    ``keep_id`` is the id of the row that stays: of the texts with the most characters (code points, ignored ones
    too) that with the smallest id, null ids last; of rows equal in that too any one stays. ``group_size`` counts the
    rows, ``kept`` is true for the row that stays. ``text_sha256`` is null for texts that were not read in full, as no
    other has their length and beginning; ``digests`` fills it for these too. A null text is an empty one. An empty
    table gives an empty result. Columns of the table named like the results are replaced by them; ids may be of any
    type.
    """
    columns = [c for c in docs.columns if c != text_column] if columns is None else columns
    text = F.regexp_replace(F.coalesce(docs[text_column].cast("string"), F.lit("")), ignored, "")
    bitmap = repeated_marks(docs.select(text.alias("text")), prefix, bitmap_bits)

    @F.pandas_udf("boolean")
    def has_company(mark: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap, mark.to_numpy().view(np.uint64)))

    # The given columns travel in a struct, so that none of them can clash with the names used here.
    given = F.struct(docs[id_column].alias("id"), *[docs[c].alias(f"c{i}") for i, c in enumerate(columns)])
    rows = docs.select(given.alias("row"), has_company(F.xxhash64(*marks(text, prefix))).alias("company"),
                       F.coalesce(F.char_length(docs[text_column].cast("string")), F.lit(0)).alias("characters"),
                       text.alias("text"))
    full = F.sha2(F.col("text").cast("binary"), 256)
    rows = rows.select("row", "company", "characters",
                       (full if digests else F.when(F.col("company"), full)).alias("digest"),
                       F.monotonically_increasing_id().alias("number"))
    rows = stored(rows, "digests")

    best = F.struct(-F.col("characters"), F.col("row.id").isNull(), F.col("row.id"), F.col("number"))
    groups = rows.where("company").groupBy("digest").agg(F.count("*").alias("size"), F.min(best).alias("best"))
    groups = stored(groups.where("size > 1").select(
        F.col("digest").alias("of"), "size", F.col("best.id").alias("keep"), F.col("best.number").alias("first")),
        "copy-groups")
    shared = rows.where("company").join(groups, F.col("digest") == F.col("of"), "left").select(
        "row", "digest", F.coalesce("first", "number").alias("first"), "number",
        F.when(F.col("of").isNull(), F.col("row.id")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("size", F.lit(1)).alias("size"))
    alone = rows.where("not company").select(
        "row", "digest", F.col("number").alias("first"), "number", F.col("row.id").alias("keep"),
        F.lit(1).cast("long").alias("size"))
    kept = [(i, c) for i, c in enumerate(columns) if c.lower() not in RESULTS]
    return shared.unionByName(alone).select(
        *[F.col(f"row.c{i}").alias(c) for i, c in kept], F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"), (F.col("number") == F.col("first")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def without_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows that stay, one of each group of equal texts, with the columns of ``docs`` as they are."""
    whole = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"),
                        F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    kept = exact_copies(whole, "id", "text", ["whole"], **options).where("kept")
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def copy_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the digest of each document."""
    return exact_copies(docs, columns=["doc_id"], digests=True, **options)
