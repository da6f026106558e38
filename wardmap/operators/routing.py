"""Question routing, guarded SQL and the data side of answering."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import flag_label, labelled, shown, yes_no
from ..session import stored
from ..sources.dimensions import (
    BLOCKED_WORDS, CONTEXT_TRIGGERS, INTENT_KEYWORDS, ROUTE_LABELS, SPECIALTY_KEYWORDS,
)
from ..sources.tables import KEY
from .flags import FLAGS, any_flag
from .geo import resolve_region
from .guard import guarded
from .regions import region_type_counts, regions_from_counts
from .search import specialty_keyword_counts

REGION = "address_stateOrRegion"


def keyword_hits(lowered: Column, words: list[str]) -> Column:
    """Number of the words that occur in a lower-case text."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(lowered, F.lit(w)), 1).otherwise(0) for w in words])


def with_intent(log: DataFrame, question: str = "question", name: str = "intent") -> DataFrame:
    """Add the intent with most keyword hits.

    Ties go to the list named first, no hit at all to SEMANTIC. Text and scores are
    columns of their own, so that each is computed once per row.
    """
    scored = log.withColumn("_lowered", F.lower(question)).withColumns(
        {f"_{label}": keyword_hits(F.col("_lowered"), words) for label, words in INTENT_KEYWORDS.items()}
    )
    scores = {label: F.col(f"_{label}") for label in INTENT_KEYWORDS}
    best = F.greatest(*scores.values())
    intent = F.when(best == 0, "SEMANTIC")
    for label, score in scores.items():
        intent = intent.when(score == best, label)
    return scored.withColumn(name, intent).drop("_lowered", *[f"_{label}" for label in scores])


def repair_label(reply: Column, labels: list[str] | None = None, default: str = "SEMANTIC") -> Column:
    """A reply as one of the valid labels: itself, else one it contains, else the default."""
    labels = labels or ROUTE_LABELS
    text = F.upper(F.btrim(reply))
    result = F.when(text.isin(*labels), text)
    for label in labels:
        result = result.when(F.contains(text, F.lit(label)), label)
    return result.otherwise(default)


# Expected routes in the words of the keyword router.
ROUTE_TO_INTENT = {"STRUCTURED": "SQL", "SEMANTIC": "SEMANTIC", "REASONING": "REASONING", "DESERT": "REASONING"}


def expected_intent(route: Column) -> Column:
    result = None
    for label, intent in ROUTE_TO_INTENT.items():
        result = F.when(route == label, intent) if result is None else result.when(route == label, intent)
    return result


def intent_counts(log: DataFrame) -> DataFrame:
    return with_intent(log).groupBy("intent").agg(F.count("*").alias("questions"))


# ---------------------------------------------------------------- guarded SQL

def strip_fence(sql: Column) -> Column:
    """SQL text without Markdown fence lines, outer blanks and closing semicolons."""
    return F.regexp_replace(
        F.btrim(F.regexp_replace(sql, r"(?m)^\s*```.*$\n?", ""), F.lit(" \t\r\n")), r"[;\s]+$", ""
    )


BLOCKED = r"(?i)\b(" + "|".join(BLOCKED_WORDS) + r")\b"


#: Quoted texts, in which a semicolon ends nothing.
QUOTED = r"""'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+"|`[^`]*+`"""


def sql_verdict(sql: Column) -> Column:
    """``allowed``, ``blocked word`` or ``several statements``; whole words only."""
    text = strip_fence(sql)
    return (
        F.when(text.rlike(BLOCKED), "blocked word")
        .when(F.contains(F.regexp_replace(text, QUOTED, "''"), F.lit(";")), "several statements").otherwise("allowed")
    )


def sql_audit(log: DataFrame) -> DataFrame:
    """Logged statements per verdict and first blocked word."""
    text = strip_fence(F.col("sql_text"))
    word = F.upper(F.nullif(F.regexp_extract(text, BLOCKED, 1), F.lit("")))
    return log.groupBy(sql_verdict(F.col("sql_text")).alias("verdict"), word.alias("blocked_word")).agg(
        F.count("*").alias("statements")
    )


def guarded_select(spark: SparkSession, sql: str, limit: int = 50, args: dict | None = None) -> DataFrame:
    """Run one SELECT over the registered views, at most ``limit`` rows of it.

    Rejects blocked words (as whole words) and what ``guard`` does not allow: several statements, tables, files and
    functions in FROM that are no registered view or name the statement itself defines, and functions that reach out of
    the data. Values belong in ``args`` (named parameters), not in the text.
    """
    text = re.sub(r"(?m)^\s*```.*$\n?", "", sql).strip().rstrip("; \n\t")
    if re.search(BLOCKED, text):
        raise ValueError("statement contains a blocked word")
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT is allowed")
    try:
        return guarded(spark, text, args).limit(limit)
    except ParseException as error:
        raise ValueError(f"not one statement that Spark can read: {error}") from error


# ---------------------------------------------------------------- mentions in questions

def _words(c: Column) -> Column:
    """The words of a text, a blank around each."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))


def mentioned_regions(log: DataFrame, regions: DataFrame, id_column: str = "event_id") -> DataFrame:
    """The longest region name that occurs in each question, as whole words.

    Questions meet the names by equality of a word with the first word of a name; only
    such pairs are searched for the whole name. The distinct names are written once, so Spark
    knows their size and picks the join by it.
    """
    names = regions.select(F.col(REGION).alias("region")).where(F.col("region").isNotNull()).distinct()
    names = names.withColumn("name_words", _words(F.col("region")))
    names = stored(
        names.withColumn("word", F.split_part("name_words", F.lit(" "), F.lit(2))), "region-names")
    asked = log.select(id_column, _words(F.col("question")).alias("question_words"))
    asked = asked.select("*", F.explode(F.array_distinct(F.split("question_words", " "))).alias("word"))
    named = asked.where(F.col("word") != "").join(names, "word").where(
        F.contains(F.col("question_words"), F.col("name_words")))
    return named.groupBy(id_column).agg(
        F.max(F.struct(F.length("region").alias("n"), "region"))["region"].alias("region")
    )


TYPE_WORDS = ["hospital", "clinic", "pharmacy", "dentist"]


def mentioned_type(question: Column) -> Column:
    """First facility type named in a question."""
    lowered = F.lower(question)
    result = None
    for word in TYPE_WORDS:
        hit = F.contains(lowered, F.lit(word))
        result = F.when(hit, word) if result is None else result.when(hit, word)
    return result


#: Longest text of a value in a summary line.
CELL = 200
LINE_COLUMNS = ["name", "facilityTypeId", "address_city", REGION, "numberDoctors", "capacity", "num_procedures",
                "num_equipment"]

#: Single values that a line shows, or that tell the flags of its facility.
FACT_COLUMNS = ["name", "facilityTypeId", "address_city", REGION, "numberDoctors", "capacity", "description"]


def facility_line(cut: int = CELL) -> Column:
    """One-line summary of a facility for a reasoning context; ``listed`` holds its specialties."""
    # Labels of the line, in order.
    cell = lambda c: F.left(shown(F.col(c)), F.lit(cut))
    return F.concat(
        F.lit("- "), cell("name"), F.lit(" ["), cell("facilityTypeId"), F.lit("] in "), cell("address_city"),
        F.lit(", "), cell(REGION), F.lit(" | Doctors: "), cell("numberDoctors"), F.lit(" | Beds: "),
        cell("capacity"), F.lit(" | Specialties: "), F.coalesce("listed", F.lit("[]")),
        F.lit(" | Procedures: "), cell("num_procedures"), F.lit(" | Equipment: "), cell("num_equipment"),
    )


def specialty_texts(claims: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """The sorted specialties of the given facilities as JSON text, cut to ``CELL`` characters.

    An item takes at least three characters, so more than ``CELL`` of them are never needed.
    """
    own = claims.where(F.col("field") == "specialties").join(keys.select(key).distinct(), key, "left_semi")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("item"))).where(F.col("n") <= CELL)
    return first.groupBy(key).agg(F.left(F.to_json(F.array_sort(F.collect_list("item"))), F.lit(CELL)).alias("listed"))


def reasoning_contexts(f: DataFrame, claims: DataFrame, n: int = 20) -> DataFrame:
    """Context text per (region or any, type or any): its ``n`` best facilities as lines.

    Best means flagged first, then most sources. Facilities are first cut to the ``n`` best
    of their own region and type; the wider combinations only need those, and lines are built
    for these few alone.
    """
    columns = [F.desc("has_flag"), F.desc("source_count"), KEY]
    own = Window.partitionBy("region", "type").orderBy(*columns)
    cells = [c for c in LINE_COLUMNS if c not in (REGION, "facilityTypeId")]
    finest = f.select(
        KEY, any_flag().alias("has_flag"), "source_count", *cells,
        F.col(REGION).alias("region"), F.col("facilityTypeId").alias("type"),
    ).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n).drop("rank")
    finest = stored(finest, "best-facilities")
    lines = finest.join(specialty_texts(claims, finest), KEY, "left").withColumnsRenamed(
        {"region": REGION, "type": "facilityTypeId"}).select(KEY, facility_line().alias("line"))
    any_value = F.lit(None).cast("string")
    options = F.array_distinct(F.array(*[
        F.struct(r.alias("region"), t.alias("type"))
        for r in (F.col("region"), any_value) for t in (F.col("type"), any_value)
    ]))
    rows = finest.select(KEY, "has_flag", "source_count", F.inline(options))
    order = Window.partitionBy("region", "type").orderBy(*columns)
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).join(lines, KEY)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return best.groupBy("region", "type").agg(ordered.alias("l")).select(
        "region", "type", F.size("l").cast("bigint").alias("facilities"),
        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"),
    )


def question_facts(log: DataFrame, regions: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Region and type each question names (NULL where it names none)."""
    typed = log.select(id_column, "question", mentioned_type(F.col("question")).alias("type"))
    return typed.join(mentioned_regions(log, regions, id_column), id_column, "left")


def question_reasoning(log: DataFrame, f: DataFrame, claims: DataFrame, regions: DataFrame, n: int = 20) -> DataFrame:
    """Reasoning context of every question; questions with the same facts share one text."""
    # Written, so that Spark knows its size in bytes and picks the join by it.
    contexts = stored(reasoning_contexts(f, claims, n).select(
        F.col("region").alias("_r"), F.col("type").alias("_t"), "facilities", "context"
    ), "reasoning-contexts")
    facts = question_facts(log, regions)
    matched = facts["region"].eqNullSafe(F.col("_r")) & facts["type"].eqNullSafe(F.col("_t"))
    return facts.join(contexts, matched, "left").select(
        "event_id", "region", "type", F.coalesce("facilities", F.lit(0).cast("bigint")).alias("facilities"),
        F.coalesce("context", F.lit("No matching facilities found.")).alias("context"),
    )


def region_lines(regions: DataFrame) -> DataFrame:
    """One summary line per region."""
    parts = [
        labelled("Facilities", F.col("facility_count")), labelled("Doctors", F.col("total_doctors")),
        labelled("Beds", F.col("total_beds")), labelled("Hospitals", F.col("hospital_count")),
        *[labelled(label, yes_no(F.col(c))) for label, c in [
            ("Surgery", "has_surgery"), ("Emergency", "has_emergency"),
            ("Obstetrics", "has_obstetrics"), ("Pediatrics", "has_pediatrics")]],
        labelled("Score", F.col("desert_score")),
    ]
    return regions.select(
        REGION, F.concat(shown(F.col(REGION)), F.lit(" | "), F.concat_ws(" | ", *parts)).alias("line")
    )


# ---------------------------------------------------------------- structured context

BLOCK_ORDER = ["totals", "regions", *[f"specialty {w}" for w in SPECIALTY_KEYWORDS], "anomalies", "deserts"]


def _joined(rows: DataFrame, order: list[Column], line: Column) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return rows.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


# Texts of the context lines and of questions that ask for none.
TOTAL_LINE, TYPES_LINE, REGION_LINE, ANOMALY_LINE = "Total facilities: ", "\nBy type: ", "Region ", "Anomalies - "
SPECIALTY_LINE, NO_DATA = "Facilities with ", "No structured data pulled."


def context_texts(f: DataFrame, claims: DataFrame) -> DataFrame:
    """Text of every structured context block; a block is a short aggregate of the tables.

    Facilities are folded once to counts per region and type, which are written; every
    block folds those further. Region texts are resolved to the known regions, so the blocks
    have a bounded number of lines; texts without one are counted as ``N/A``.
    """
    counts = region_type_counts(f).withColumn(REGION, resolve_region(F.col(REGION)))
    sums = [F.sum(c).alias(c) for c in counts.columns if c not in (REGION, "facilityTypeId")]
    rollup = stored(counts.groupBy(REGION, "facilityTypeId").agg(*sums), "region-types")
    regions = regions_from_counts(rollup)
    per_type = rollup.groupBy("facilityTypeId").agg(F.sum("facility_count").alias("n"))
    block = lambda name, df: df.select(F.lit(name).alias("block"), "text")
    total = F.concat(F.lit(TOTAL_LINE), F.sum("n").cast("string"), F.lit(TYPES_LINE))
    by_type = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), shown(F.col("facilityTypeId")).alias("t"))))
    totals = per_type.agg(F.concat(total, F.array_join(F.transform(
        by_type, lambda x: F.concat(x["t"], F.lit(": "), (-x["o"]).cast("string"))), ", ")).alias("text"))
    region_text = _joined(
        regions, [-F.col("facility_count"), shown(F.col(REGION))],
        F.concat(F.lit(REGION_LINE), shown(F.col(REGION)), F.lit(": "), F.col("facility_count").cast("string"),
                 F.lit(" facilities, "), F.col("total_doctors").cast("string"), F.lit(" doctors")),
    )
    anomalies = rollup.agg(*[F.sum(c).alias(c) for c in FLAGS]).select(F.concat_ws(
        "\n", *[F.concat(F.lit(ANOMALY_LINE), flag_label(F.lit(c)), F.lit(": "), F.col(c).cast("string"))
                for c in FLAGS]).alias("text"))
    worst = regions.orderBy(F.desc("desert_score"), F.asc_nulls_first(REGION)).limit(5)
    deserts = _joined(
        worst, [-F.col("desert_score"), F.coalesce(REGION, F.lit(""))],
        F.concat(shown(F.col(REGION)), F.lit(": score="), F.col("desert_score").cast("string"),
                 F.lit(", facilities="), F.col("facility_count").cast("string"),
                 F.lit(", doctors="), F.col("total_doctors").cast("string"),
                 F.lit(", surgery="), yes_no(F.col("has_surgery"))),
    )
    specialties = specialty_keyword_counts(claims).select(
        F.concat(F.lit("specialty "), F.col("keyword")).alias("block"),
        F.concat(F.lit(SPECIALTY_LINE), F.col("keyword"), F.lit(": "), F.col("facilities").cast("string"))
        .alias("text"),
    )
    parts = [block("totals", totals), block("regions", region_text), specialties,
             block("anomalies", anomalies), block("deserts", deserts)]
    return reduce(DataFrame.unionByName, parts)


def triggered_blocks(lowered: Column) -> Column:
    """Names of the context blocks a question, given in lower case, asks for, in block order."""
    words = CONTEXT_TRIGGERS | {f"specialty {w}": [w] for w in SPECIALTY_KEYWORDS}
    hit = {b: reduce(lambda x, y: x | y, [F.contains(lowered, F.lit(w)) for w in ws]) for b, ws in words.items()}
    return F.filter(F.array(*[F.when(hit[b], F.lit(b)) for b in BLOCK_ORDER]), F.isnotnull)


def question_structured_context(log: DataFrame, texts: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Structured context of every question, blocks in fixed order.

    The block texts, a fixed number of bounded rows (``context_texts``), become one map value (a
    scalar subquery), so the questions are neither joined nor shuffled.
    """
    lookup = texts.agg(F.map_from_entries(F.collect_list(F.struct("block", "text")))).scalar()
    lowered = log.select(id_column, F.lower("question").alias("lowered"))
    asked = lowered.select(id_column, triggered_blocks(F.col("lowered")).alias("asked")).withColumn("texts", lookup)
    found = asked.select(id_column, F.array_compact(
        F.transform("asked", lambda b: F.try_element_at(F.col("texts"), b))).alias("found"))
    return found.select(
        id_column, F.size("found").cast("bigint").alias("blocks"),
        F.when(F.size("found") > 0, F.array_join("found", "\n"))
        .otherwise(NO_DATA).alias("context"),
    )
