"""Change feed between snapshots and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import KEY


def row_hash(df: DataFrame, key: str = KEY) -> Column:
    """Hash over all non-key columns; which of them are NULL counts too."""
    return F.xxhash64(*[x for c in sorted(df.columns) if c != key for x in (F.col(c).isNull(), F.col(c))])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """Keys inserted, updated or deleted between two snapshots of a keyed table.

    Only key and hash take part in the join; both sides have one row per key.
    """
    before = old.select(key, row_hash(old, key).alias("old_hash"))
    after = new.select(key, row_hash(new, key).alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete")
        .when(F.col("old_hash") != F.col("new_hash"), "update")
    )
    return before.join(after, key, "full_outer").select(key, change.alias("change")).where(F.col("change").isNotNull())


def upsert(current: DataFrame, changes: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Newest row per key over a table and its changes, by the version columns.

    A fixed-size maximum per key, so a much-updated key is folded before the exchange.
    """
    rows = current.unionByName(changes, allowMissingColumns=True)
    payload = [c for c in rows.columns if c not in (key, *version)]
    newest = F.max_by(F.struct(*version, *payload), F.struct(*version))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def sync_index(old: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """What an index of (key, page, search_text) has to apply: the pages that come, change or go.

    The texts themselves are compared, so a page whose text is the same is not written again, and pages that
    a shorter list no longer has are deleted.
    """
    before = old.select(key, "page", F.col("search_text").alias("old_text"))
    change = (
        F.when(F.col("old_text").isNull(), "insert").when(F.col("search_text").isNull(), "delete")
        .when(F.col("old_text") != F.col("search_text"), "update")
    )
    return before.join(new, [key, "page"], "full_outer").withColumn("change", change).where(
        F.col("change").isNotNull()).select(key, "page", "change", "search_text")
