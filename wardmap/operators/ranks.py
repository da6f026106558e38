"""Ranks and medians over all values of a column, with the values dealt out by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def running_counts(counts: DataFrame, order: Column, n: str = "n") -> DataFrame:
    """Add ``place`` (1, 2, ... along ``order``) and ``before`` (sum of ``n`` of earlier rows) to distinct values.

    A task numbers the values of its range; one row for each range tells what comes before it.
    """
    ranges = stored(counts.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    places, rows, starts = 0, 0, []
    for part, size, total in sorted(ranges.groupBy("_range").agg(F.count("*"), F.sum(n)).collect()):
        starts.append((part, places, rows))
        places, rows = places + size, rows + total
    starts = counts.sparkSession.createDataFrame(starts, "_range int, _places long, _rows long")
    own = Window.partitionBy("_range").orderBy(order)
    up_to = F.sum(n).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("place", F.row_number().over(own)).withColumn("before", up_to - F.col(n)).join(
        starts, "_range").select(
            *counts.columns, (F.col("place") + F.col("_places")).alias("place"),
            (F.col("before") + F.col("_rows")).alias("before"))


def median(df: DataFrame, value: Column) -> float | None:
    """The median of a column; of an even number of values the mean of the two in the middle."""
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    counts = stored(running_counts(counts, F.col("v").asc()), "running-counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    inside = lambda rank: (F.col("before") < rank) & (F.col("before") + F.col("n") >= rank)
    middle = [(total + 1) // 2, (total + 2) // 2]
    found = counts.where(inside(middle[0]) | inside(middle[1])).select("v").collect()
    return sum(r.v for r in found) / len(found)
