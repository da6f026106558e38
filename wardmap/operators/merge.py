"""Merging repeated mentions of a facility.

A facility may hold a large share of all mentions. Single values and counts are therefore
folded as fixed-size aggregates, and list items are made distinct per (facility, field,
item), which spreads a large facility over all tasks. Lists are only assembled from the
distinct items, in pages of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import json_items, trimmed_items
from ..functions.values import blank_to_null, hash_slot, is_known, safe_name
from ..session import stored
from ..sources.tables import KEY, LIST_FIELDS, ROW_RANK, SINGLE_FIELDS, SOURCE

PAGE_SIZE = 10_000
SALT = 16


def merge_singles(
    mentions: DataFrame, key: str = KEY, source: str = SOURCE, fields: list[str] | None = None
) -> DataFrame:
    """One row per key: per field the known value of the first source in URL order.

    Null words do not count as values. Fields absent from the input are left out and
    column names lose blanks and dots. ``source_count`` counts the mentions. Of a bucketed
    table only the ranks of rows are folded, numbers of a fixed width, and the few rows that
    give a value are looked up by them.
    """
    names = {f: safe_name(f) for f in (fields or SINGLE_FIELDS) if f in mentions.columns}
    url = F.coalesce(F.col(source), F.lit("")).alias("_url")
    if ROW_RANK in mentions.columns:
        return _merge_by_rank(mentions, names, key)
    known = mentions.select(key, url, *[blank_to_null(F.col(f"`{f}`")).alias(name) for f, name in names.items()])
    merged = [F.min(F.when(F.col(c).isNotNull(), F.struct("_url", c)))[c].alias(c) for c in names.values()]
    return known.groupBy(key).agg(*merged, F.count("*").alias("source_count"))


def _merge_by_rank(mentions: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """``merge_singles`` of a table with ``ROW_RANK``, which is in URL order within a key.

    Texts are trimmed only in the rows that give a value.
    """
    rank = F.col(ROW_RANK)
    rows = mentions.select(key, rank, *[F.col(f"`{f}`").alias(name) for f, name in names.items()])
    firsts = rows.groupBy(key).agg(
        *[F.min(F.when(is_known(F.col(c)), rank)).alias(f"_{c}") for c in names.values()],
        F.count("*").alias("source_count"))
    # At most a row for each field of a key is left; both sides are bucketed alike.
    giving = rows.join(firsts.hint("shuffle_hash"), key).where(rank.isin(*[F.col(f"_{c}") for c in names.values()]))
    values = giving.groupBy(key).agg(
        *[F.max(F.when(rank == F.col(f"_{c}"), blank_to_null(F.col(c)))).alias(c) for c in names.values()])
    return firsts.select(key, "source_count").join(values, key, "left").select(key, *names.values(), "source_count")


def exploded_claims(
    mentions: DataFrame, fields: list[str] | None = None, key: str = KEY, source: str = SOURCE
) -> DataFrame:
    """One row per (key, source, field, item) mention of the list fields."""
    return _list_texts(mentions, fields, key, source).select(
        key, source, "field", F.explode(json_items(F.col("_text"))).alias("item"))


def _list_texts(mentions: DataFrame, fields: list[str] | None, *columns: str) -> DataFrame:
    """One row per mention and list field that has a text."""
    fields = [f for f in (fields or LIST_FIELDS) if f in mentions.columns]
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_text")) for f in fields])
    return mentions.select(*columns, F.inline(texts)).where(F.col("_text").isNotNull())


def distinct_claims(mentions: DataFrame, fields: list[str] | None = None, key: str = KEY) -> DataFrame:
    """Distinct (key, field, item) over all sources: the union of each facility's lists."""
    items = _list_texts(mentions, fields, key).select(key, "field", F.explode(trimmed_items(F.col("_text"))).alias("item"))
    return items.where(F.col("item") != "").distinct()


def paged_lists(
    items: DataFrame, key: str = KEY, value: str = "item", page_size: int = PAGE_SIZE
) -> DataFrame:
    """Distinct (key, field, value) rows as sorted arrays of about ``page_size`` values.

    Nearly every list is one page (``n_pages`` = 1). A longer one is cut by the hash of its
    values, so no row and no task ever holds it whole, and nothing is left out. The items and
    the page counts of long lists are written first: the items are made once, and Spark knows
    that the counts are few or none, so that nothing is moved to hand them out. Should they be
    many, the join is salted for the same reason.
    """
    keys = [key, "field"]
    items = stored(items, "list-items")
    long = stored(
        items.groupBy(*keys).agg(F.count("*").alias("n"))
        .where(F.col("n") > page_size)
        .select(*keys, F.ceil(F.col("n") / page_size).cast("bigint").alias("n_pages"),
                F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt")),
        "long-lists")
    return (
        items.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALT).cast("bigint")))
        .join(long, [*keys, "salt"], "left")
        .withColumn("n_pages", F.coalesce("n_pages", F.lit(1).cast("bigint")))
        .withColumn("page", F.when(F.col("n_pages") == 1, F.lit(0).cast("bigint"))
                    .otherwise(hash_slot(F.concat(F.col(value).cast("string"), F.lit("#page")), F.col("n_pages"))))
        # All fields of a page meet, so that ``list_columns`` need not move the lists.
        .repartition(key, "page")
        .groupBy(*keys, "page", "n_pages")
        .agg(F.sort_array(F.collect_list(value)).alias("items"))
    )


def list_columns(pages: DataFrame, fields: list[str], key: str = KEY) -> DataFrame:
    """One row per key and page with an array column per field, empty where the page has none of it.

    Nearly every key has one page, ``list_page`` 0. All items are there: those of a longer list on several
    pages, ``list_pages`` being the number of pages of the longest list on the page.
    """
    empty = F.array().cast("array<string>")
    return pages.groupBy(key, F.col("page").alias("list_page")).agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("items"))), empty).alias(f) for f in fields],
        F.max("n_pages").alias("list_pages"),
    )


def merge_by_key(mentions: DataFrame, key: str = KEY, page_size: int = PAGE_SIZE) -> DataFrame:
    """One record per facility: merged single values and merged, sorted lists.

    A facility with a list of more than ``page_size`` items has a record for each page, with the same single
    values. No item is left out, and no items at all are an empty list.
    """
    fields = [f for f in LIST_FIELDS if f in mentions.columns]
    pages = paged_lists(distinct_claims(mentions, fields, key), key, page_size=page_size)
    empty = F.array().cast("array<string>")
    merged = merge_singles(mentions, key).join(list_columns(pages, fields, key), key, "left")
    return merged.select(
        *[c for c in merged.columns if c not in (*fields, "list_page", "list_pages")],
        *[F.coalesce(f, empty).alias(f) for f in fields],
        F.coalesce("list_page", F.lit(0).cast("bigint")).alias("list_page"),
        F.coalesce("list_pages", F.lit(1).cast("bigint")).alias("list_pages"),
    )


def merge_raw_text(
    mentions: DataFrame, fields: list[str], separator: str = " | ", key: str = KEY, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Distinct raw texts of each field joined by a separator, unparsed, per key and page."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields])
    raw = mentions.select(key, F.inline(texts)).where(F.col("item").isNotNull()).distinct()
    pages = paged_lists(raw, key, page_size=page_size)
    return pages.select(key, "field", "page", "n_pages", F.array_join("items", separator).alias("merged_text"))


def facility_sources(mentions: DataFrame, key: str = KEY, source: str = SOURCE) -> DataFrame:
    """Distinct (key, source URL) pairs."""
    return mentions.select(key, source).where(F.col(source).isNotNull()).distinct()


def source_url_lists(mentions: DataFrame, key: str = KEY, page_size: int = PAGE_SIZE) -> DataFrame:
    """Sorted source URLs of each facility, in pages."""
    rows = facility_sources(mentions, key).select(key, F.lit("source_urls").alias("field"), F.col(SOURCE).alias("item"))
    return paged_lists(rows, key, page_size=page_size).drop("field").withColumnRenamed("items", "source_urls")


def duplicate_statistics(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """Rows, distinct keys and their difference, in one pass."""
    per_key = mentions.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_rows"),
        # A NULL key is no facility.
        F.count(key).alias("unique_keys"),
        F.max("n").alias("most_mentions"),
    ).withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_keys"))


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys with more than one row; empty for a merged table."""
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def url_host(url: Column) -> Column:
    """Host of a URL without a leading ``www.``; the scheme may be missing."""
    with_scheme = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.regexp_replace(F.lower(F.try_parse_url(with_scheme, F.lit("HOST"))), r"^www\.", "")


def corroborated_claims(
    mentions: DataFrame, fields: list[str], min_hosts: int = 2, key: str = KEY
) -> DataFrame:
    """Per claim: facilities making it, and those backed by ``min_hosts`` independent hosts."""
    hosts = (
        exploded_claims(mentions, fields, key)
        .select(key, "field", "item", url_host(F.col(SOURCE)).alias("host"))
        .distinct()
        .groupBy(key, "field", "item")
        .agg(F.count("host").alias("n_hosts"))
    )
    return hosts.groupBy("field", "item").agg(
        F.count("*").alias("facilities"),
        F.count_if(F.col("n_hosts") >= min_hosts).alias("corroborated"),
    )
