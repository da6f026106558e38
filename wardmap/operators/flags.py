"""Facility counts, anomaly flags and the prepared anomaly queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import flag_label, is_true, shown, to_int
from ..session import stored
from ..sources.dimensions import EQUIPMENT_RULES, TYPE_CLAIM_RULES
from ..sources.tables import KEY
from .merge import PAGE_SIZE, distinct_claims, list_columns, merge_singles, paged_lists

SIGNAL_FIELDS = ["specialties", "procedure", "equipment", "capability"]
COUNT_COLUMNS = {
    "num_procedures": "procedure",
    "num_equipment": "equipment",
    "num_capabilities": "capability",
    "num_specialties": "specialties",
}
# Whether some item of the field contains the text (a regular expression over lower case).
SIGNALS = {
    "claims_surgery": ("specialties", "surgery"),
    "claims_emergency": ("specialties", "emergency"),
    "claims_obstetrics": ("specialties", "obstetrics"),
    "claims_pediatrics": ("specialties", "pediatrics"),
    "does_surgery": ("procedure", "surg"),
    "offers_emergency": ("capability", "emergency|24"),
}
FLAGS = [
    "flag_procedures_no_doctors",
    "flag_capacity_no_equipment",
    "flag_clinic_claims_surgery",
    "flag_too_many_specialties",
    "flag_sparse_record",
    "flag_high_capacity_no_surgery",
    "flag_many_specialties_small_size",
    "flag_no_doctors_listed",
    "flag_emergency_not_offered",
]


def claim_signals(claims: DataFrame, key: str = KEY, fields: list[str] | None = None) -> DataFrame:
    """Fixed-size summary of a facility's distinct claims: item counts and yes/no signals."""
    fields = fields or SIGNAL_FIELDS
    counts = [
        F.count_if(F.col("field") == field).cast("int").alias(c) for c, field in COUNT_COLUMNS.items() if field in fields
    ]
    signals = [
        F.max((F.col("field") == field) & F.lower("item").rlike(pattern)).alias(c)
        for c, (field, pattern) in SIGNALS.items() if field in fields
    ]
    return claims.groupBy(key).agg(*counts, *signals)


def with_flags(facilities: DataFrame) -> DataFrame:
    """Add the nine anomaly flags; an unknown comparison leaves a flag false."""
    doctors, beds, kind = F.col("numberDoctors"), F.col("capacity"), F.col("facilityTypeId")
    no_text = F.col("num_procedures") + F.col("num_equipment") + F.col("num_capabilities") == 0
    rules = [
        (F.col("num_procedures") > 5) & (doctors.isNull() | (doctors < 2)),
        (beds > 50) & (F.col("num_equipment") == 0),
        (kind == "clinic") & F.col("claims_surgery"),
        (F.col("num_specialties") > 5) & (doctors.isNull() | (doctors < 5)),
        no_text & F.col("description").isNull(),
        (beds > 50) & ~F.col("does_surgery"),
        (F.col("num_specialties") > 5) & (beds > 0) & (beds < 20),
        (kind == "hospital") & doctors.isNull(),
        F.col("claims_emergency") & ~F.col("offers_emergency"),
    ]
    return facilities.withColumns({name: is_true(rule) for name, rule in zip(FLAGS, rules)})


def typed_singles(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """Merged single values with the numeric ones as integers."""
    singles = merge_singles(mentions, key)
    numbers = [c for c in ("yearEstablished", "area", "numberDoctors", "capacity") if c in singles.columns]
    return singles.withColumns({c: to_int(F.col(c)) for c in numbers})


def with_signals(mentions: DataFrame, fields: list[str] | None = None, key: str = KEY) -> DataFrame:
    """Merged single values with the counts and signals of the given list fields.

    Lists not asked for are neither read nor parsed. Both sides of the join are aggregated
    to one row per facility, so it cannot skew, and both arrive partitioned by the key.
    """
    fields = fields or SIGNAL_FIELDS
    singles = typed_singles(mentions, key)
    signals = claim_signals(distinct_claims(mentions, fields, key), key, fields)
    joined = singles.join(signals, key, "left")
    known = {c: F.coalesce(c, F.lit(0)) for c in COUNT_COLUMNS if c in signals.columns}
    known |= {c: is_true(F.col(c)) for c in SIGNALS if c in signals.columns}
    return joined.withColumns(known)


def enrich(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """Merged single values with item counts, claim signals and flags."""
    return with_flags(with_signals(mentions, SIGNAL_FIELDS, key))


def any_flag(columns: list[str] | None = None) -> Column:
    """True where at least one flag is set."""
    return F.greatest(*[is_true(F.col(c)) for c in (columns or FLAGS)])


def set_flags(columns: list[str] | None = None) -> Column:
    """Names of the set flags."""
    return F.filter(F.array(*[F.when(is_true(F.col(c)), F.lit(c)) for c in (columns or FLAGS)]), F.isnotnull)


def flag_summary(facilities: DataFrame) -> DataFrame:
    """Flagged facilities per flag, all flags counted in a single pass."""
    totals = facilities.agg(*[F.count_if(F.col(c)).alias(c) for c in FLAGS])
    return totals.unpivot([], FLAGS, "flag", "facilities").withColumn("label", flag_label(F.col("flag")))


DISPLAY_COLUMNS = [
    "name", "address_stateOrRegion", "facilityTypeId", "numberDoctors", "capacity",
    "num_procedures", "num_equipment", "num_specialties",
]


def flagged_table(facilities: DataFrame) -> DataFrame:
    """Flagged facilities as display text with the names of their flags."""
    return facilities.where(any_flag()).select(
        KEY, *[shown(F.col(c)).alias(c) for c in DISPLAY_COLUMNS], F.array_join(set_flags(), ", ").alias("flags")
    )


def browse_flagged(facilities: DataFrame, flag: str | None = None, region: str | None = None) -> DataFrame:
    """Facilities with a chosen flag (any flag if None) in a chosen region (all if None)."""
    chosen = facilities.where(F.col(flag) if flag else any_flag())
    if region is not None:
        chosen = chosen.where(F.col("address_stateOrRegion") == region)
    return chosen


def with_specialty_list(
    facilities: DataFrame, mentions: DataFrame, key: str = KEY, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Attach the sorted specialty list to facility rows, a row for each ``list_page`` of it."""
    pages = paged_lists(distinct_claims(mentions, ["specialties"], key), key, page_size=page_size)
    listed = facilities.join(list_columns(pages, ["specialties"], key), key, "left").drop("list_pages")
    return listed.withColumn("list_page", F.coalesce("list_page", F.lit(0).cast("bigint")))


def unrealistic_procedures(f: DataFrame) -> DataFrame:
    return f.where("num_procedures > 5 AND (numberDoctors IS NULL OR numberDoctors < 2)").select(
        KEY, "name", "address_stateOrRegion", "facilityTypeId", "numberDoctors",
        "num_procedures", "num_equipment", "num_specialties",
    )


def mismatched_capabilities(f: DataFrame) -> DataFrame:
    return f.where("claims_surgery AND num_equipment = 0").select(
        KEY, "name", "address_stateOrRegion", "facilityTypeId", "num_equipment", "numberDoctors"
    )


def clinic_claims_surgery(f: DataFrame) -> DataFrame:
    return f.where("flag_clinic_claims_surgery").select(
        KEY, "name", "address_city", "address_stateOrRegion", "num_procedures", "numberDoctors"
    )


def high_capacity_no_equipment(f: DataFrame) -> DataFrame:
    return f.where("flag_capacity_no_equipment").select(
        KEY, "name", "address_stateOrRegion", "facilityTypeId", "capacity", "numberDoctors",
        "num_equipment", "num_procedures",
    )


def too_many_specialties(f: DataFrame) -> DataFrame:
    return f.where("flag_too_many_specialties").select(
        KEY, "name", "address_stateOrRegion", "facilityTypeId", "num_specialties", "numberDoctors", "capacity"
    )


def correlated_features(f: DataFrame) -> DataFrame:
    """Features that should rise together but do not.

    The label needs a known doctor count where the filter accepts an unknown one, so such
    rows are labelled by a later branch or as "Other mismatch".
    """
    beds_gap = (F.col("capacity") > 100) & (F.col("num_equipment") < 3)
    breadth = F.col("num_specialties") > 5
    few_doctors = F.col("numberDoctors") < 3
    tools_gap = (F.col("num_procedures") > 10) & (F.col("num_equipment") < 2)
    kind = (
        F.when(beds_gap, "Large capacity, minimal equipment")
        .when(breadth & few_doctors, "Many specialties, few doctors")
        .when(tools_gap, "Many procedures, almost no equipment")
        .otherwise("Other mismatch")
    )
    hit = is_true(beds_gap) | is_true(breadth & (F.col("numberDoctors").isNull() | few_doctors)) | is_true(tools_gap)
    return f.where(hit).select(
        KEY, "name", "address_stateOrRegion", "facilityTypeId", "numberDoctors", "capacity",
        "num_procedures", "num_equipment", "num_specialties", kind.alias("mismatch_type"),
    )


def single_facility_dependency(f: DataFrame, at_most: int = 2) -> DataFrame:
    """Region and facility type pairs with at most two facilities that claim surgery."""
    return (
        f.where("claims_surgery")
        .groupBy("address_stateOrRegion", "facilityTypeId")
        .agg(F.count("*").alias("facility_count"),
             F.sum(F.coalesce("numberDoctors", F.lit(0))).alias("total_doctors"))
        .where(F.col("facility_count") <= at_most)
    )


def breadth_outliers(f: DataFrame, z_limit: float = 1.5) -> DataFrame:
    """Facilities whose procedures per unit of infrastructure are far above the mean.

    The ratio is procedures over 1 + equipment + doctors; a facility is listed when its
    ratio lies more than ``z_limit`` population standard deviations above the mean. The
    ratios are written once; the two statistics over them are scalar subqueries, so no
    window gathers the table.
    """
    support = F.lit(1) + F.col("num_equipment") + F.coalesce("numberDoctors", F.lit(0))
    rated = f.select(KEY, "name", "num_procedures", "num_equipment", "numberDoctors",
                     (F.col("num_procedures") / support).alias("ratio"))
    rated = stored(rated, "breadth-ratios")
    mean = rated.agg(F.avg("ratio")).scalar()
    spread = rated.agg(F.nullif(F.stddev_pop("ratio"), F.lit(0.0))).scalar()
    return rated.withColumn("z_score", (F.col("ratio") - mean) / spread).where(F.col("z_score") > z_limit)


def equipment_checks(claims: DataFrame, key: str = KEY, rules=None) -> DataFrame:
    """Per facility and rule: whether it makes the claim, and owns the equipment for it."""
    rules = rules or EQUIPMENT_RULES
    aggregates = []
    for i, (_, procedure, equipment) in enumerate(rules):
        aggregates.append(F.max((F.col("field") == "procedure") & F.col("item").rlike(procedure)).alias(f"claims_{i}"))
        aggregates.append(F.max((F.col("field") == "equipment") & F.col("item").rlike(equipment)).alias(f"owns_{i}"))
    cells = F.array(*[
        F.struct(F.lit(label).alias("rule"), F.col(f"claims_{i}").alias("claims"), F.col(f"owns_{i}").alias("owns"))
        for i, (label, _, _) in enumerate(rules)
    ])
    return claims.groupBy(key).agg(*aggregates).select(key, F.inline(cells)).where("claims")


def missing_equipment(claims: DataFrame, key: str = KEY, rules=None) -> DataFrame:
    """Claims made without the required equipment."""
    return equipment_checks(claims, key, rules).where(~F.col("owns")).select(key, "rule")


def equipment_compliance(claims: DataFrame, key: str = KEY, rules=None) -> DataFrame:
    """Per rule the share of claiming facilities that list the required equipment."""
    return (
        equipment_checks(claims, key, rules)
        .groupBy("rule")
        .agg(F.count("*").alias("claiming"), F.count_if("owns").alias("equipped"))
        .withColumn("share", F.round(F.col("equipped") / F.col("claiming"), 6))
    )


def type_claim_mismatch(facilities: DataFrame, claims: DataFrame, key: str = KEY, rules=None) -> DataFrame:
    """Facilities with claims that do not fit their type, with the number of such claims."""
    rules = rules or TYPE_CLAIM_RULES
    hits = F.filter(
        F.array(*[F.when((F.col("field") == field) & F.col("item").rlike(pattern), F.lit(kind))
                  for kind, field, pattern in rules]),
        F.isnotnull,
    )
    per_facility = (
        claims.select(key, F.explode(F.array_distinct(hits)).alias("facilityTypeId"))
        .groupBy(key, "facilityTypeId").agg(F.count("*").alias("odd_claims"))
    )
    return facilities.select(key, "name", "facilityTypeId").join(per_facility, [key, "facilityTypeId"])


def credibility(f: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW trust in a record, from sources, specifics and flags.

    Own thresholds: one point each for two or more and for five or more sources, for any
    equipment and for three or more items of it, for a known doctor count; one point off
    per set flag. HIGH from 4 points, MEDIUM from 2.
    """
    one = lambda condition: F.when(condition, 1).otherwise(0)
    points = (
        one(F.col("source_count") >= 2) + one(F.col("source_count") >= 5)
        + one(F.col("num_equipment") >= 1) + one(F.col("num_equipment") >= 3)
        + one(F.col("numberDoctors").isNotNull()) - F.size(set_flags())
    )
    return f.select(
        KEY, points.alias("points"),
        F.when(points >= 4, "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW").alias("credibility"),
    )
