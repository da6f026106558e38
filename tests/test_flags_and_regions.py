import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardmap.operators import flags, profile, ranks, regions

REGION = "address_stateOrRegion"
COLUMNS = (
    "pk_unique_id int, name string, address_stateOrRegion string, facilityTypeId string, organization_type string, "
    "numberDoctors int, capacity int, description string, source_count long, num_procedures int, num_equipment int, "
    "num_capabilities int, num_specialties int, claims_surgery boolean, claims_emergency boolean, "
    "claims_obstetrics boolean, claims_pediatrics boolean, does_surgery boolean, offers_emergency boolean"
)
DEFAULTS = dict(
    name="n", address_stateOrRegion="R", facilityTypeId="hospital", organization_type="facility", numberDoctors=9,
    capacity=10, description="d", source_count=1, num_procedures=0, num_equipment=1, num_capabilities=1,
    num_specialties=1, claims_surgery=False, claims_emergency=False, claims_obstetrics=False,
    claims_pediatrics=False, does_surgery=True, offers_emergency=True,
)


def facilities(spark, *rows):
    full = [{"pk_unique_id": i, **DEFAULTS, **row} for i, row in enumerate(rows)]
    return flags.with_flags(spark.createDataFrame([tuple(r.values()) for r in full], COLUMNS))


@pytest.mark.parametrize("row, expected", [
    ({}, []),
    ({"num_procedures": 6, "numberDoctors": 1}, ["flag_procedures_no_doctors"]),
    ({"num_procedures": 5, "numberDoctors": 1}, []),
    ({"capacity": 51, "num_equipment": 0}, ["flag_capacity_no_equipment"]),
    ({"capacity": None, "num_equipment": 0}, []),
    ({"facilityTypeId": "clinic", "claims_surgery": True}, ["flag_clinic_claims_surgery"]),
    ({"facilityTypeId": None, "claims_surgery": True}, []),
    ({"num_specialties": 6, "numberDoctors": 4}, ["flag_too_many_specialties", "flag_many_specialties_small_size"]),
    ({"num_equipment": 0, "num_capabilities": 0, "description": None}, ["flag_sparse_record"]),
    ({"capacity": 60, "does_surgery": False}, ["flag_high_capacity_no_surgery"]),
    ({"num_specialties": 6, "capacity": 0}, []),
    ({"numberDoctors": None}, ["flag_no_doctors_listed"]),
    ({"claims_emergency": True, "offers_emergency": False}, ["flag_emergency_not_offered"]),
])
def test_flags(spark, row, expected):
    got = facilities(spark, row).select(flags.set_flags().alias("f"), flags.any_flag().alias("a")).first()
    assert got["f"] == expected and got["a"] == bool(expected)


def test_mismatch_label_needs_a_known_doctor_count(spark):
    f = facilities(spark, {"num_specialties": 6, "numberDoctors": None}, {"num_specialties": 6, "numberDoctors": 2},
                   {"capacity": 101, "num_equipment": 2}, {"num_procedures": 11, "num_equipment": 1})
    got = {r[0]: r["mismatch_type"] for r in flags.correlated_features(f).collect()}
    assert got == {0: "Other mismatch", 1: "Many specialties, few doctors", 2: "Large capacity, minimal equipment",
                   3: "Many procedures, almost no equipment"}


def test_linear_score(spark):
    f = facilities(spark, {"claims_surgery": True}, {"claims_emergency": True, "claims_obstetrics": True})
    assert regions.regional_analysis(f).first()["desert_score"] == 100 - 4 - 18 - 10 - 10 - 5


def test_weighted_score_bounds_and_null_region(spark):
    f = facilities(
        spark, {}, {}, {REGION: "empty", "numberDoctors": None, "capacity": None, "does_surgery": False, "offers_emergency": False},
        {REGION: None})
    got = {r[REGION]: r["desert_score"] for r in regions.weighted_regions(f).collect()}
    assert got == {"R": 0.0, "empty": 80.0}
    assert None in {r[REGION] for r in regions.weighted_regions(f, drop_null_region=False).collect()}


def test_weighted_score_without_any_resource(spark):
    f = facilities(spark, {"numberDoctors": None, "capacity": None, "does_surgery": False, "offers_emergency": False})
    assert regions.weighted_regions(f).first()["desert_score"] == 60.0


@pytest.mark.parametrize("score, band", [(80.1, "Critical"), (80.0, "High"), (50.0, "Moderate"), (20.0, "Adequate")])
def test_bands(spark, score, band):
    assert spark.range(1).select(regions.score_band(F.lit(score))).first()[0] == band


def test_ties_keep_all_regions_with_most(spark):
    f = facilities(spark, {}, {REGION: "S"}, {REGION: "T", "facilityTypeId": "clinic"})
    assert {r[REGION] for r in regions.region_with_most(f).collect()} == {"R", "S"}


def test_rank_filter_is_applied_before_the_exchange(spark):
    plan = regions.top_per_region(facilities(spark, {}, {}), 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_missing_and_single_point(spark):
    f = facilities(spark, {}, {}, {REGION: "S"})
    claims = spark.createDataFrame(
        [(0, "specialties", "cardiology"), (1, "specialties", "cardiology"), (1, "specialties", "pediatrics")],
        "pk_unique_id int, field string, item string")
    wanted = ["cardiology", "pediatrics"]
    got = {r[0]: r["missing"] for r in regions.missing_specialties(f, claims, wanted).collect()}
    assert got == {"R": [], "S": wanted}
    assert [tuple(r) for r in regions.single_point_dependencies(f, claims).collect()] == [("R", "pediatrics", 1)]


def test_ngo_gap(spark):
    f = facilities(spark, {"organization_type": "ngo"}, {REGION: "S"}, {REGION: None, "organization_type": "ngo"})
    scored = spark.createDataFrame([("R", 90.0), ("S", 90.0), ("T", 10.0)], f"{REGION} string, desert_score double")
    assert [r[0] for r in regions.ngo_gaps(f, scored).collect()] == ["S"]


def test_service_bundles_match_all_pairs(spark):
    rows = [(i, "procedure" if j % 2 else "equipment", f"i{j}") for i in range(40) for j in range(8) if (i * 7 + j * 3) % 5 < 2]
    claims = spark.createDataFrame(rows, "pk_unique_id int, field string, item string")
    baskets = {}
    for key, _, item in rows:
        baskets.setdefault(key, set()).add(item)
    counts = {}
    for basket in baskets.values():
        for a in basket:
            for b in basket:
                if a < b:
                    counts[a, b] = counts.get((a, b), 0) + 1
    limit = 0.2 * len(baskets)
    expected = {(a, b, n) for (a, b), n in counts.items() if n >= limit}
    assert expected and {tuple(r) for r in profile.service_bundles(claims, 0.2).collect()} == expected


def test_value_shares_add_up(spark):
    f = facilities(spark, {}, {}, {"facilityTypeId": "clinic"}, {"facilityTypeId": None})
    got = {r[0]: r["percent"] for r in profile.value_shares(f, "facilityTypeId").collect()}
    assert got == {"hospital": 66.666667, "clinic": 33.333333}


def test_browse(spark):
    f = facilities(spark, {"numberDoctors": None}, {"numberDoctors": None, REGION: "S"}, {})
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(flags.browse_flagged(f)) == [0, 1]
    assert ids(flags.browse_flagged(f, "flag_no_doctors_listed", "S")) == [1]


def test_bundles_of_many_shared_items_are_counted_not_mined(spark):
    claims = spark.createDataFrame(
        [(f"f{i}", "procedure", f"p{j:02d}", "r1" if i < 30 else None) for i in range(40) for j in range(25)],
        "pk_unique_id string, field string, item string, region string")
    pairs = profile.service_bundles(claims, 0.9).collect()
    assert len(pairs) == 25 * 24 // 2 and {r["facilities"] for r in pairs} == {40}
    by = profile.service_bundles(claims, 0.9, by="region").collect()
    assert {(r["region"], r["facilities"]) for r in by} == {("r1", 30), (None, 10)} and len(by) == 2 * len(pairs)


def test_rules_for_equipment_and_type_of_problem(spark):
    claims = spark.createDataFrame(
        [("a", "procedure", "Cataract surgery"), ("a", "equipment", "Operating theatre"), ("b", "procedure", "MRI of the head"),
         ("b", "equipment", "mri scanner")], "pk_unique_id string, field string, item string")
    assert [tuple(r) for r in flags.missing_equipment(claims).collect()] == [("a", "cataract surgery")]
    f = spark.createDataFrame([("x", 1, 1.0, 10), ("y", 2, 2.0, 0), ("z", 3, 90.0, 5)],
                              "address_stateOrRegion string, pk_unique_id int, numberDoctors double, num_equipment long")
    got = {r["address_stateOrRegion"]: r["shortage"] for r in regions.problem_type(f).collect()}
    assert got == {"x": "practitioners", "y": "equipment", "z": "neither"}


def test_ranks_and_medians_over_ranges(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 500, 501):
        values = [rng.randrange(40) / 4 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(7)
        assert ranks.median(df, F.col("v")) == statistics.median(values)
        table = df.withColumnRenamed("v", "desert_score").withColumn("address_stateOrRegion", F.lit("x"))
        order = sorted(set(values), reverse=True)
        got = {r.desert_score: r.priority for r in regions.priority_ranking(table).collect()}
        assert got == {None: None} | {v: i + 1 for i, v in enumerate(order)}
    assert ranks.median(df.limit(0), F.col("v")) is None
