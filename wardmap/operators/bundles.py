"""Service bundles of any size: closed item sets, found level by level over bitmaps of facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import KEY

#: Facilities of a bitmap word, as a power of two.
WORD_BITS = 6


def numbered(services: DataFrame, key: str) -> DataFrame:
    """Services with the word and bit of their facility; the numbers of facilities have no great gaps."""
    keys = stored(services.select(key, "bundle_group").distinct().withColumn("number", F.monotonically_increasing_id()),
                  "facility-numbers")
    bit = F.expr(f"shiftleft(1L, cast(number & {(1 << WORD_BITS) - 1} as int))")
    return services.join(keys, [key, "bundle_group"]).select(
        "bundle_group", "item", F.shiftright("number", WORD_BITS).alias("word"), bit.alias("bit"))


def closed_bundles(
    services: DataFrame, min_support: float, key: str = KEY, by: str | None = None, least_items: int = 2,
) -> DataFrame:
    """Sets of items that at least ``min_support`` of the facilities (of a group ``by``) share and that no larger set
    of items is shared by as often: ``by``, items (sorted) and facilities.

    A set is followed by what it becomes with one further item, closed over all items that the same facilities share. It
    is kept where the closing adds no item before the added one, so every closed set is reached once and no subset of
    it is listed. The sets of a level live as bitmap words of 64 facilities; a level joins them to the words of the items
    and counts bits, so its cost follows sets x items x facilities / 64, spread evenly over the words.
    """
    group = F.col(by) if by else F.lit(None).cast("string")
    services = stored(services.select(key, F.struct(group.alias("by")).alias("bundle_group"), "item").where(
        "item is not null").distinct(), "services")
    sizes = services.groupBy("bundle_group").agg(F.ceil(F.round(F.count_distinct(key) * F.lit(min_support), 9)).alias("least"))
    frequent = services.groupBy("bundle_group", "item").agg(F.count("*").alias("n")).join(sizes, "bundle_group").where(
        "n >= least").select("bundle_group", "item", "least")
    bits = numbered(services, key)
    words = bits.join(frequent, ["bundle_group", "item"]).groupBy("bundle_group", "word", "item").agg(
        F.bit_or("bit").alias("bits"), F.first("least").alias("least"))
    words = stored(words, "item-words")
    everyone = bits.groupBy("bundle_group", "word").agg(F.bit_or("bit").alias("held")).select(
        "bundle_group", F.lit("").alias("set"), F.array().cast("array<string>").alias("items"),
        F.lit(None).cast("string").alias("added"), "word", "held")
    state, found = stored(everyone, "bundle-words"), None
    while not state.isEmpty():
        together = F.bit_count(F.col("held").bitwiseAND(F.col("bits")))
        counts = state.join(words, ["bundle_group", "word"]).groupBy("bundle_group", "set", "items", "added", "item").agg(
            F.sum(together).alias("n"), F.first("least").alias("least"))
        support = state.groupBy("bundle_group", "set").agg(F.sum(F.bit_count("held")).alias("facilities"))
        rows = counts.join(support, ["bundle_group", "set"])
        # At most a row for each frequent item of the set's group.
        sets = rows.groupBy("bundle_group", "set", "items", "added", "facilities").agg(
            F.array_sort(F.collect_list(F.when(F.col("n") == F.col("facilities"), F.col("item")))).alias("closed"),
            F.array_sort(F.collect_list(F.when((F.col("n") < F.col("facilities")) & (F.col("n") >= F.col("least")),
                                               F.col("item")))).alias("further"))
        own = F.col("added").isNull() | ~F.exists(
            "closed", lambda i: (i < F.col("added")) & ~F.array_contains("items", i))
        sets = stored(sets.where(own), "closed-sets")
        found = sets if found is None else found.unionByName(sets)
        nexts = sets.select("bundle_group", "set", "closed", F.explode(F.filter(
            "further", lambda i: F.col("added").isNull() | (i > F.col("added")))).alias("next"))
        grown = state.select("bundle_group", "set", "word", "held").join(nexts, ["bundle_group", "set"]).join(
            words.select("bundle_group", "word", F.col("item").alias("next"), "bits"), ["bundle_group", "word", "next"])
        held = F.col("held").bitwiseAND(F.col("bits"))
        state = stored(grown.select(
            "bundle_group", F.md5(F.to_json(F.array_append("closed", F.col("next"))).cast("binary")).alias("set"),
            F.col("closed").alias("items"), F.col("next").alias("added"), "word", held.alias("held")).where("held <> 0"),
            "bundle-words")
    columns = [F.col("bundle_group.by").alias(by)] if by else []
    kind = F.array().cast("array<string>")
    if found is None:
        return services.limit(0).select(*columns, kind.alias("items"), F.lit(0).cast("bigint").alias("facilities"))
    return found.where(F.size("closed") >= least_items).select(*columns, F.col("closed").alias("items"), "facilities")
