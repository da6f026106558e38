"""Traces, citations and evaluation of answered questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import KEY
from .routing import expected_intent, with_intent

REGION = "address_stateOrRegion"


def citations(log: DataFrame, facilities: DataFrame, first: int = 10, id_column: str = "event_id") -> DataFrame:
    """Name and region of the first ``first`` cited facilities of each answer.

    Ids are compared as text on both sides; unknown ids give no citation.
    """
    cited = log.select(id_column, F.posexplode("source_ids").alias("pos", "id")).where(F.col("pos") < first)
    names = facilities.select(F.col(KEY).cast("string").alias("id"), "name", F.col(REGION).alias("region"))
    return cited.join(names, "id").select(id_column, "pos", "id", "name", "region")


def citation_lists(cited: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Citations per answer as an ordered array and as JSON (at most ``first`` entries)."""
    entry = F.struct("pos", F.struct("id", "name", "region").alias("c"))
    lists = cited.groupBy(id_column).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    ordered = F.transform("e", lambda x: x["c"])
    return lists.select(id_column, F.size("e").cast("bigint").alias("citation_count"),
                        F.to_json(ordered, {"ignoreNullFields": "false"}).alias("citations_json"))


def trace_rows(log: DataFrame, preview: int = 500) -> DataFrame:
    """Rows of the trace table: one per answered question."""
    return log.select(
        F.col("event_id"), "question", F.col("expected_route").alias("category"),
        F.get(F.col("steps"), F.lit(1))["step"].alias("agent_used"),
        F.length("answer").cast("bigint").alias("answer_length"),
        F.least(F.size("source_ids"), F.lit(10)).cast("bigint").alias("citation_count"),
        F.bround(F.col("total_ms") / 1000.0, 2).alias("total_time_seconds"),
        F.col("ts").alias("timestamp"),
        F.left(F.col("answer"), F.lit(preview)).alias("answer_preview"),
        F.to_json(F.struct("question", "steps")).alias("trace_json"),
    )


def step_latency(log: DataFrame) -> DataFrame:
    """Count, mean, median and worst time per step, and mean citations, over all traces.

    The median is the lower one of the sorted times, exact at any size: times are whole milliseconds, counted first, so
    that only the distinct ones of a step are put in order.
    """
    steps = log.select(F.size("source_ids").alias("sources"), F.inline("steps"))
    counts = steps.groupBy("step", "ms").agg(F.count("*").alias("n"), F.sum("sources").alias("sources"),
                                             F.count("sources").alias("known"))
    up_to = F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))).over(Window.partitionBy("step").orderBy("ms"))
    every = F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))).over(Window.partitionBy("step"))
    counts = counts.withColumn("lower", F.col("ms").isNotNull() & (2 * up_to >= every))
    total = lambda c: F.sum(F.col(c) * F.col("n"))
    timed = F.sum(F.when(F.col("ms").isNotNull(), F.col("n")))
    return counts.groupBy("step").agg(
        F.sum("n").alias("runs"),
        F.round(total("ms") / timed, 6).alias("avg_ms"),
        F.min(F.when(F.col("lower"), F.col("ms"))).alias("median_ms"),
        F.max("ms").alias("max_ms"),
        F.round(F.sum("sources") / F.sum("known"), 6).alias("avg_sources"),
    )


def evaluated(log: DataFrame) -> DataFrame:
    """Routed questions with the outcome against the expected route."""
    return with_intent(log, name="actual_intent").select(
        "event_id", "question_id", "question_category", "expected_route", "actual_intent",
        (F.col("actual_intent") == expected_intent(F.col("expected_route"))).alias("correct_route"),
        F.length("answer").cast("bigint").alias("answer_length"), "total_ms",
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("correct_route").alias("correct"),
        F.round(100.0 * F.count_if("correct_route") / F.count("*"), 6).alias("accuracy_percent"),
        F.round(F.avg("total_ms") / 1000.0, 6).alias("avg_seconds"),
        F.round(F.avg("answer_length"), 6).alias("avg_answer_length"),
    )


def evaluation_by_category(rows: DataFrame) -> DataFrame:
    """Outcome per question category with a total row (category ``ALL``); questions without one keep NULL."""
    return rows.rollup("question_category").agg(
        F.count("*").alias("total"),
        F.count_if("correct_route").alias("correct"),
        F.round(F.avg("total_ms") / 1000.0, 6).alias("avg_seconds"),
        F.grouping("question_category").alias("is_total"),
    ).select(
        F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("question_category")).alias("category"),
        "total", "correct", "avg_seconds",
    )


def route_confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected_route", "actual_intent").agg(F.count("*").alias("questions"))

