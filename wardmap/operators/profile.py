"""Counts, shares, coverage and quality profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lists import json_items
from ..functions.values import blank_to_null
from ..session import stored
from ..sources.tables import KEY
from .flags import any_flag

NUMERIC_FEATURES = ["numberDoctors", "capacity", "num_procedures", "num_equipment", "num_specialties"]
CONTACT_FIELDS = ["email", "officialWebsite", "officialPhone", "facebookLink"]


def value_counts(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Rows per value; missing values as their own label or as NULL."""
    value = F.coalesce(F.col(column), F.lit(missing)) if missing is not None else F.col(column)
    return df.groupBy(value.alias(column)).agg(F.count("*").alias("row_count"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Known values with count and percentage of all known values."""
    known = df.where(F.col(column).isNotNull())
    counts = stored(known.groupBy(column).agg(F.count("*").alias("row_count")), "value-counts")
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("percent", F.round(100.0 * F.col("row_count") / total, 6))


def type_profile(f: DataFrame) -> DataFrame:
    """Facilities, mean doctors and mean beds per type; unknown numbers are ignored."""
    return f.groupBy("facilityTypeId").agg(
        F.count("*").alias("facility_count"),
        F.round(F.avg("numberDoctors"), 6).alias("avg_doctors"),
        F.round(F.avg("capacity"), 6).alias("avg_beds"),
    )


def list_coverage(mentions: DataFrame, fields: list[str]) -> DataFrame:
    """Per list field the rows with at least one item and their whole percentage."""
    totals = mentions.agg(F.count("*").alias("total_rows"),
                          *[F.count_if(F.size(json_items(F.col(c))) > 0).alias(c) for c in fields])
    return totals.unpivot(["total_rows"], fields, "field", "rows_with_data").withColumn(
        "percent", F.floor(100 * F.col("rows_with_data") / F.nullif(F.col("total_rows"), F.lit(0))).cast("bigint")
    )


def key_figures(f: DataFrame) -> DataFrame:
    """The dashboard's headline numbers, in one pass."""
    return f.agg(
        F.count("*").alias("facilities"),
        F.count_if(F.col("facilityTypeId") == "hospital").alias("hospitals"),
        F.count_if(F.col("facilityTypeId") == "clinic").alias("clinics"),
        F.countDistinct("address_stateOrRegion").alias("regions"),
        F.sum("numberDoctors").alias("doctors"),
        F.sum("capacity").alias("beds"),
        F.count_if(any_flag()).alias("flagged"),
    )


def feature_correlation(f: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every feature pair over rows where both are known."""
    features = features or NUMERIC_FEATURES
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    row = f.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    names = [f"{a}~{b}" for a, b in pairs]
    return row.unpivot([], [F.col(f"`{n}`") for n in names], "pair", "corr").select(
        F.split_part("pair", F.lit("~"), F.lit(1)).alias("feature_a"),
        F.split_part("pair", F.lit("~"), F.lit(2)).alias("feature_b"),
        F.round("corr", 6).alias("corr"),
    )


def contact_quality(f: DataFrame) -> DataFrame:
    """Correlation of contact completeness (0-4 channels) with claimed capability."""
    score = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in CONTACT_FIELDS])
    claims = F.col("num_procedures") + F.col("num_equipment") + F.col("num_capabilities")
    return f.select(score.alias("s"), claims.alias("c")).agg(
        F.count("*").alias("facilities"),
        F.round(F.avg("s"), 6).alias("avg_contact_score"),
        F.round(F.corr("s", "c"), 6).alias("corr"),
    )


def default_tag_share(claims: DataFrame, tag: str = "internalMedicine", key: str = KEY) -> DataFrame:
    """Share of facilities whose only specialty is the default tag."""
    per = claims.where(F.col("field") == "specialties").groupBy(key).agg(
        F.count("*").alias("n"), F.max(F.col("item") == tag).alias("has_tag")
    )
    return per.agg(
        F.count("*").alias("with_specialty"),
        F.count_if((F.col("n") == 1) & F.col("has_tag")).alias("only_default"),
    ).withColumn("share", F.round(F.col("only_default") / F.nullif(F.col("with_specialty"), F.lit(0)), 6))


def column_profile(df: DataFrame, columns: list[str], list_columns: list[str]) -> DataFrame:
    """Per column: rows, missing values (null words included) and distinct values.

    A list column counts as missing when it has no item. The long form keeps one fixed-size
    state per (column, value), so any number of columns is profiled in one exchange.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), blank_to_null(F.col(f"`{c}`")).alias("value")) for c in columns]
    cells += [
        F.struct(F.lit(c).alias("column_name"),
                 F.when(F.size(json_items(F.col(c))) > 0, F.to_json(json_items(F.col(c)))).alias("value"))
        for c in list_columns
    ]
    values = df.select(F.inline(F.array(*cells))).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"),
    )


def service_bundles(claims: DataFrame, min_support: float, key: str = KEY, by: str | None = None) -> DataFrame:
    """Procedure and equipment pairs that at least ``min_support`` of the facilities share, overall or per ``by``.

    Only frequent items enter a facility's basket, and there are at most (mean claims per facility /
    ``min_support``) of those; pairs are made within these bounded baskets and counted.
    """
    group = [by] if by else []
    services = stored(claims.where(F.col("field").isin("procedure", "equipment"))
                      .select(key, *group, "item").distinct(), "services")
    least = F.ceil(F.round(F.countDistinct(key) * F.lit(min_support), 9)).alias("at_least")
    needed = services.groupBy(F.coalesce(F.col(by), F.lit("")) if by else F.lit("")).agg(least).toDF("_group", "at_least")
    rows = services.withColumn("_group", F.coalesce(F.col(by), F.lit("")) if by else F.lit(""))
    frequent = rows.groupBy("_group", "item").agg(F.count("*").alias("n")).join(needed, "_group").where("n >= at_least")
    baskets = rows.join(frequent.select("_group", "item"), ["_group", "item"], "left_semi").groupBy(
        key, *group, "_group").agg(F.array_sort(F.collect_list("item")).alias("items"))
    first = baskets.select(*group, "_group", "items", F.posexplode("items").alias("place", "item_a"))
    pairs = first.select(*group, "_group", "item_a",
                         F.explode(F.slice("items", F.col("place") + 2, F.size("items"))).alias("item_b"))
    counted = pairs.groupBy(*group, "_group", "item_a", "item_b").agg(F.count("*").alias("facilities"))
    return counted.join(needed, "_group").where("facilities >= at_least").select(*group, "item_a", "item_b", "facilities")
