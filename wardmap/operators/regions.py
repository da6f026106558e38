"""Regional tables, underservice scores and rankings.

Everything here aggregates facilities to one row per region with fixed-size states, so a
region holding much of the table is folded before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import blank_to_null
from ..session import stored
from ..sources.dimensions import CRITICAL_SPECIALTIES
from ..sources.tables import KEY
from .flags import FLAGS, any_flag
from .merge import paged_lists
from .ranks import median, running_counts

REGION = "address_stateOrRegion"


def _total(column: str) -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(0))).cast("bigint")


def regional_stats(f: DataFrame) -> DataFrame:
    """Facilities, doctors, beds and distinct facility types per region."""
    return f.groupBy(REGION).agg(
        F.count("*").alias("facility_count"),
        _total("numberDoctors").alias("total_doctors"),
        _total("capacity").alias("total_beds"),
        F.countDistinct("facilityTypeId").alias("facility_types"),
    )


def specialty_coverage(f: DataFrame) -> DataFrame:
    """Sum and mean of specialty counts per region."""
    return f.groupBy(REGION).agg(
        F.sum("num_specialties").alias("total_specialty_slots"),
        F.round(F.avg("num_specialties"), 6).alias("avg_specialties_per_facility"),
    )


def _measures() -> dict[str, Column]:
    """What one facility adds to its region's totals."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "facility_count": F.lit(1),
        "total_doctors": F.coalesce("numberDoctors", F.lit(0)),
        "total_beds": F.coalesce("capacity", F.lit(0)),
        "hospital_count": one(F.col("facilityTypeId") == "hospital"),
        "has_surgery": one(F.col("claims_surgery")),
        "has_emergency": one(F.col("claims_emergency")),
        "has_obstetrics": one(F.col("claims_obstetrics")),
        "has_pediatrics": one(F.col("claims_pediatrics")),
        "sparse_records": one(F.col("flag_sparse_record")),
    }


def _with_linear_score(totals: DataFrame) -> DataFrame:
    # Weights of the linear score.
    return totals.withColumn(
        "desert_score",
        F.lit(100) - 2 * F.col("facility_count") - F.col("total_doctors")
        - 10 * F.col("has_surgery") - 10 * F.col("has_emergency") - 5 * F.col("has_obstetrics"),
    )


def regional_analysis(f: DataFrame) -> DataFrame:
    """Nine aggregates per region and the linear underservice score (unbounded below)."""
    return _with_linear_score(f.groupBy(REGION).agg(*[F.sum(c).alias(name) for name, c in _measures().items()]))


def region_type_counts(f: DataFrame) -> DataFrame:
    """The regional aggregates and the flag counts per region and facility type."""
    flags = [F.count_if(c).alias(c) for c in FLAGS]
    return f.groupBy(REGION, "facilityTypeId").agg(
        *[F.sum(c).alias(name) for name, c in _measures().items()], *flags)


def regions_from_counts(counts: DataFrame) -> DataFrame:
    """The regional analysis from counts per region and type."""
    return _with_linear_score(counts.groupBy(REGION).agg(*[F.sum(c).alias(c) for c in _measures()]))


def weighted_regions(f: DataFrame, drop_null_region: bool = True) -> DataFrame:
    """Regional table with the weighted 0-100 score, relative to the best region.

    The regional table is written once, so that taking its maxima does not run the
    aggregation again. Surgery and emergency count as present or absent. Rounded half to
    even, to one decimal.
    """
    rows = f.where(blank_to_null(F.col(REGION)).isNotNull()) if drop_null_region else f
    base = rows.groupBy(REGION).agg(
        F.count("*").alias("facility_count"),
        _total("numberDoctors").alias("total_doctors"),
        _total("capacity").alias("total_beds"),
        F.count_if("does_surgery").alias("has_surgery"),
        F.count_if("offers_emergency").alias("has_emergency"),
        F.count_if(F.col("facilityTypeId") == "hospital").alias("num_hospitals"),
        F.round(F.avg("num_specialties"), 6).alias("avg_specialties"),
    )
    base = stored(base, "regional-base")

    def shortfall(column: str) -> Column:
        best = base.agg(F.coalesce(F.nullif(F.max(column), F.lit(0)), F.lit(1))).scalar()
        return 1 - F.col(column) / best

    def absent(column: str) -> Column:
        return 1 - F.least(F.lit(1), F.greatest(F.lit(0), F.col(column)))

    # Weights of the 0-100 score.
    score = (
        40 * shortfall("facility_count") + 25 * shortfall("total_doctors") + 20 * shortfall("total_beds")
        + 10 * absent("has_surgery") + 5 * absent("has_emergency")
    )
    # A guard digit keeps sums such as 62.35 from landing on either side of a tie.
    return base.withColumn("desert_score", F.bround(F.round(score, 9), 1))


def score_band(score: Column) -> Column:
    """Critical above 80, High above 50, Moderate above 20, else Adequate."""
    return F.when(score > 80, "Critical").when(score > 50, "High").when(score > 20, "Moderate").otherwise("Adequate")


def map_rows(regions: DataFrame) -> DataFrame:
    """What a region map needs: band, marker size, risk and hub notes."""
    score = F.col("desert_score")
    return regions.select(
        REGION, "facility_count", "desert_score",
        score_band(score).alias("band"),
        F.greatest(F.lit(15), 50 - 2 * F.col("facility_count")).alias("marker_radius"),
        ((score > 50) & (F.col("has_emergency") == 0)).alias("lives_at_risk"),
        (F.col("has_surgery") > 10).alias("expertise_hub"),
    )


def most_underserved(regions: DataFrame, n: int = 5) -> DataFrame:
    return regions.orderBy(F.desc("desert_score"), F.asc_nulls_first(REGION)).limit(n)


def critical_regions(regions: DataFrame, above: float = 50, n: int = 5) -> DataFrame:
    return most_underserved(regions.where(F.col("desert_score") > above), n)


def priority_ranking(regions: DataFrame) -> DataFrame:
    """Dense rank by falling score: the place of the score among the distinct ones."""
    scores = regions.select("desert_score").where("desert_score is not null").groupBy("desert_score").agg(
        F.count("*").alias("n"))
    places = running_counts(scores, F.col("desert_score").desc()).select(
        F.col("desert_score").alias("_score"), F.col("place").cast("int").alias("priority"))
    return regions.join(places, F.col("desert_score") == F.col("_score"), "left").select(REGION, "desert_score", "priority")


def region_with_most(f: DataFrame, facility_type: str = "hospital") -> DataFrame:
    """Region or, on a tie, regions with the most facilities of a type."""
    counts = (
        f.where(F.col("facilityTypeId") == facility_type)
        .groupBy(REGION).agg(F.count("*").alias("facility_count"))
    )
    counts = stored(counts, "region-counts")
    return counts.where(F.col("facility_count") == counts.agg(F.max("facility_count")).scalar())


def prioritised(f: DataFrame, n: int = 20) -> DataFrame:
    """Flagged facilities first, then those with most sources."""
    return (
        f.select(KEY, "name", REGION, any_flag().alias("has_flag"), "source_count")
        .orderBy(F.desc("has_flag"), F.desc("source_count"), KEY)
        .limit(n)
    )


def top_per_region(f: DataFrame, n: int = 30) -> DataFrame:
    """First ``n`` facilities of each region by sources.

    The rank filter is pushed below the exchange (window group limit), so a task sends at
    most ``n`` rows per region.
    """
    order = Window.partitionBy(REGION).orderBy(F.desc("source_count"), KEY)
    return (
        f.select(KEY, "name", REGION, "facilityTypeId", "source_count")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


def with_region_scores(f: DataFrame, regions: DataFrame) -> DataFrame:
    """Facilities with the score of their region; an unknown region joins its own row."""
    scores = stored(
        regions.select(F.col(REGION).alias("_region"), "desert_score", "facility_count"), "region-scores")
    return f.join(scores, F.col(REGION).eqNullSafe(F.col("_region")), "left").drop("_region")


def concentration(f: DataFrame) -> DataFrame:
    """Share of a region's doctors and beds held by its largest facility."""
    share = lambda c: F.round(F.max(c) / F.nullif(F.sum(c), F.lit(0)), 6)
    return f.groupBy(REGION).agg(share("numberDoctors").alias("doctor_share"), share("capacity").alias("bed_share"))


def problem_type(f: DataFrame) -> DataFrame:
    """Whether a region is short of equipment, of practitioners, of both or of neither.

    A region is short of one where its mean per facility lies below the median of all regions' means.
    """
    sums = stored(f.groupBy(REGION).agg(
        F.count("*").alias("n"), _total("numberDoctors").alias("doctors"), _total("num_equipment").alias("tools")
    ), "regional-sums")
    doctors = F.lit(median(sums, F.col("doctors") / F.col("n")))
    tools = F.lit(median(sums, F.col("tools") / F.col("n")))
    rated = sums.select(
        REGION,
        (F.col("doctors") / F.col("n")).alias("doctors_per_facility"),
        (F.col("tools") / F.col("n")).alias("equipment_per_facility"),
    )
    few_doctors = F.col("doctors_per_facility") < doctors
    few_tools = F.col("equipment_per_facility") < tools
    return rated.select(
        REGION,
        F.round("doctors_per_facility", 6).alias("doctors_per_facility"),
        F.round("equipment_per_facility", 6).alias("equipment_per_facility"),
        F.when(few_doctors & few_tools, "both").when(few_tools, "equipment")
        .when(few_doctors, "practitioners").otherwise("neither").alias("shortage"),
    )


def missing_specialties(f: DataFrame, claims: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Critical specialties no facility of a region offers.

    One yes/no state per wanted specialty and region; the claims never gather in a list.
    """
    wanted = wanted or CRITICAL_SPECIALTIES
    offers = claims.where(F.col("field") == "specialties").groupBy(KEY).agg(
        *[F.max(F.col("item") == s).alias(s) for s in wanted]
    )
    rows = f.select(KEY, REGION).join(offers, KEY, "left")
    offered = rows.groupBy(REGION).agg(*[F.coalesce(F.max(s), F.lit(False)).alias(s) for s in wanted])
    return offered.select(
        REGION, F.filter(F.array(*[F.when(~F.col(s), F.lit(s)) for s in wanted]), F.isnotnull).alias("missing")
    )


def regional_claims(f: DataFrame, claims: DataFrame, field: str) -> DataFrame:
    """Per region and item of a field: number of facilities, and the least facility key.

    Claims are distinct per facility, so a plain count is exact and folds before the
    exchange.
    """
    rows = claims.where(F.col("field") == field).join(f.select(KEY, REGION), KEY)
    return rows.groupBy(REGION, "item").agg(F.count("*").alias("facilities"), F.min(KEY).alias("first_facility"))


def specialties_by_region(f: DataFrame, claims: DataFrame) -> DataFrame:
    """Sorted set of specialties per region, from the distinct (region, specialty) pairs, in pages."""
    pairs = regional_claims(f, claims, "specialties").select(REGION, F.lit("specialties").alias("field"), "item")
    return paged_lists(pairs, REGION).drop("field").withColumnRenamed("items", "specialties")


def single_point_dependencies(f: DataFrame, claims: DataFrame, field: str = "specialties") -> DataFrame:
    """Items offered by exactly one facility of a region, with that facility."""
    return regional_claims(f, claims, field).where(F.col("facilities") == 1).drop("facilities")


def scarce_items(f: DataFrame, claims: DataFrame, field: str = "procedure", at_most: int = 2) -> DataFrame:
    """Items of a region that depend on very few facilities."""
    return regional_claims(f, claims, field).where(F.col("facilities") <= at_most).drop("first_facility")


def supply_bands(f: DataFrame, claims: DataFrame, field: str = "procedure",
                 over: float = 0.25, under: float = 0.02) -> DataFrame:
    """Share of a region's facilities that offer an item, banded.

    Own thresholds: oversupply from a quarter of the facilities, scarcity up to 2 percent.
    """
    totals = stored(f.groupBy(REGION).agg(F.count("*").alias("region_facilities")), "region-totals")
    items = regional_claims(f, claims, field).drop("first_facility")
    share = F.col("facilities") / F.col("region_facilities")
    return (
        items.join(totals, items[REGION].eqNullSafe(totals[REGION])).drop(totals[REGION])
        .withColumn("share", F.round(share, 6))
        .withColumn("supply", F.when(share >= over, "oversupply").when(share <= under, "scarce").otherwise("normal"))
    )


def ngo_gaps(f: DataFrame, regions: DataFrame, above: float = 50) -> DataFrame:
    """Regions in need (score above the limit) where no NGO works."""
    served = f.where((F.col("organization_type") == "ngo") & F.col(REGION).isNotNull()).select(REGION).distinct()
    return regions.where(F.col("desert_score") > above).join(served, REGION, "left_anti")


def ngo_overlaps(f: DataFrame, claims: DataFrame, at_least: int = 2) -> DataFrame:
    """Specialties offered by several NGOs of one region."""
    ngos = f.where(F.col("organization_type") == "ngo")
    return (
        regional_claims(ngos, claims, "specialties").where(F.col("facilities") >= at_least)
        .select(REGION, F.col("item").alias("specialty"), F.col("facilities").alias("ngos"))
    )


def per_head(regions: DataFrame, population: DataFrame, per: int = 100_000) -> DataFrame:
    """Facilities, doctors and beds per head of a user-supplied population table."""
    rate = lambda c: F.round(F.col(c) * per / F.nullif(F.col("population"), F.lit(0)), 6)
    return regions.join(population, REGION, "left").select(
        REGION, "population",
        rate("facility_count").alias("facilities_per_head"),
        rate("total_doctors").alias("doctors_per_head"),
        rate("total_beds").alias("beds_per_head"),
    )


def workforce(f: DataFrame, signal: str = "claims_surgery") -> DataFrame:
    """Where a workforce practises: claiming facilities and their doctors by region."""
    return (
        f.where(F.col(signal)).groupBy(REGION)
        .agg(F.count("*").alias("facilities"), _total("numberDoctors").alias("doctors"),
             F.count_if(F.col("numberDoctors").isNull()).alias("doctors_unknown"))
    )


def unclear_location(f: DataFrame) -> DataFrame:
    """Per region, specialist facilities whose place of practice is unclear.

    Unclear means no phone and no e-mail and no website, or no doctor count.
    """
    unreachable = F.col("email").isNull() & F.col("officialWebsite").isNull() & F.col("officialPhone").isNull()
    return (
        f.where(F.col("num_specialties") > 0).groupBy(REGION)
        .agg(F.count("*").alias("specialist_facilities"),
             F.count_if(unreachable | F.col("numberDoctors").isNull()).alias("unclear"))
    )
