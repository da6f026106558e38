import math
import random

import pytest
from pyspark.sql import functions as F

from wardmap.functions.geo import EARTH_RADIUS_KM, cell_distances, cell_of, haversine_km, jitter
from wardmap.operators import catchment, geo


def distance(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    h = math.sin(a) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(b) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("region, expected", [
    ("Western North", "Western North"), ("Bono East", "Bono East"), ("Ahafo", "Ahafo"), ("greater accra ", "Greater Accra"),
    ("Bolgatanga Municipal", "Upper East"), ("Ga East", "Greater Accra"), ("ho", "Volta"), ("Wa West", "Upper West"),
    ("Kumasi Metropolitan, Ashanti", "Ashanti"), ("Brong Ahafo Region", "Brong-Ahafo"), ("Homeland", None),
    ("null", None), (None, None),
])
def test_resolve_region(spark, region, expected):
    df = spark.createDataFrame([(region,)], "r string")
    assert df.select(geo.resolve_region(F.col("r"))).first()[0] == expected


def test_antipodes(spark):
    df = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert df.first()[0] == pytest.approx(math.pi * EARTH_RADIUS_KM)


@pytest.mark.parametrize("km", [5.0, 300.0, 2500.0])
def test_radius_search_matches_brute_force(spark, km):
    rng = random.Random(7)
    points = [(i, rng.uniform(-58, 58), rng.uniform(-180, 180)) for i in range(400)]
    points += [(1000 + i, 5.6 + rng.uniform(-0.1, 0.1), -0.2 + rng.uniform(-0.1, 0.1)) for i in range(200)]
    points += [(2000 + i, 10.0, rng.choice([179.98, -179.98])) for i in range(5)]
    points += [(3000 + i, rng.choice([-1, 1]) * rng.uniform(58, 90), rng.uniform(-180, 180)) for i in range(300)]
    points += [(4000 + i, 75 + rng.uniform(-1, 1), 30 + rng.uniform(-4, 4)) for i in range(100)]
    places = [("accra", 5.6, -0.2), ("line", 10.0, 179.99), ("north", 55.0, 20.0), ("south", -57.0, -179.9),
              ("cold", 75.0, 30.0), ("pole", 90.0, 0.0), ("near pole", -89.5, 100.0), ("high", 80.0, -179.0)]
    df = spark.createDataFrame(points, "pk_unique_id int, lat double, lon double")
    got = {(r["pk_unique_id"], r["place"]) for r in geo.within_km(df, places, km).collect()}
    expected = {(i, p) for i, lat, lon in points for p, plat, plon in places if distance(lat, lon, plat, plon) <= km}
    assert got == expected
    counts = {r["place"]: r["facilities"] for r in geo.count_within_km(df, places, km).collect()}
    assert counts == {p[0]: sum(1 for e in expected if e[1] == p[0]) for p in places}
    cold = {r["place"] for r in geo.cold_spots(df, places, km).collect()}
    assert cold == {p for p, n in counts.items() if n == 0}


def test_jitter_is_fixed_and_bounded(spark):
    df = spark.range(2000).select("id", jitter(F.col("id"), "lat").alias("j"))
    first = {r["id"]: r["j"] for r in df.collect()}
    assert first == {r["id"]: r["j"] for r in df.repartition(5).collect()}
    assert all(-0.15 <= j < 0.15 for j in first.values()) and len(set(first.values())) > 1500


def brute_nearest(points, places, k):
    out = []
    for name, lat, lon in places:
        ranked = sorted((distance(lat, lon, y, x), key) for key, y, x in points)[:k]
        out += [(name, key, round(km, 5), i + 1) for i, (km, key) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_at_any_distance_equals_brute_force(spark, k):
    rng = random.Random(k)
    # Clusters, both poles, the date line, one hot position, and empty oceans between.
    points = [(i, rng.gauss(6, 0.3), rng.gauss(1, 0.3)) for i in range(300)]
    points += [(300 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    points += [(400, 90.0, 0.0), (401, -90.0, 10.0), (402, 0.0, 180.0), (403, 0.0, -180.0), (404, 89.99, 120.0)]
    points += [(500 + i, 6.0, 1.0) for i in range(200)]
    places = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    places += [("north", 90.0, 50.0), ("south", -89.999, 0.0), ("line", 0.1, 179.99), ("other side", -0.1, -179.99),
               ("in the cluster", 6.0, 1.0), ("near it", 6.01, 1.02), ("antipode", -6.0, -179.0)]
    table = spark.createDataFrame(points + [(900, None, 1.0)], "pk_unique_id long, lat double, lon double")
    found = geo.nearest_points(table.repartition(4), places, k)
    got = sorted((r.place, r.pk_unique_id, round(r.km, 5), r["rank"]) for r in found.collect())
    assert got == brute_nearest(points, places, k)


def test_nearest_with_few_or_no_points(spark):
    places = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0)], "place string, place_lat double, place_lon double")
    table = spark.createDataFrame([(1, -1.0, -179.0), (2, 1.0, 2.0)], "pk_unique_id long, lat double, lon double")
    assert [(r.place, r.pk_unique_id) for r in geo.nearest_points(table, places, 5).orderBy("rank").collect()] == [("a", 2), ("a", 1)]
    assert geo.nearest_points(table.limit(0), places, 5).collect() == []


def test_cell_distances_bound_what_is_in_the_cell(spark):
    rng = random.Random(9)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "lat double, lon double, y double, x double")
    for level in (0, 2, 5):
        df_l = df.select("*", *cell_of(level, F.col("y"), F.col("x")))
        near, far = cell_distances(level, F.col("lat"), F.col("lon"), F.col("row"), F.col("col"))
        km = haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
        assert df_l.where((km < near) | (km > far)).isEmpty()
        # The bounds are reached: some point of the cell is about as near.
        assert df_l.where(near > far).isEmpty()


def test_catchments_by_hand(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0, 10), ("b", 0.0, 0.2, 30), ("far", 50.0, 50.0, 5)],
                                  "place string, place_lat double, place_lon double, demand long")
    supply = spark.createDataFrame([(1, 0.0, 0.1, 8), (2, 0.0, 0.2, 2), (3, 0.0, 0.2, None), (4, 20.0, 20.0, 7)],
                                   "pk_unique_id long, lat double, lon double, supply long")
    at = lambda d: (math.exp(-0.5 * (distance(0, 0, 0, d) / 60) ** 2) - math.exp(-0.5)) / (1 - math.exp(-0.5))
    first, second = 8 / (10 * at(0.1) + 30 * at(0.1)), 2 / (10 * at(0.2) + 30)
    got = {r.place: r for r in catchment.catchment_access(cells, supply, 60.0, 0.8).collect()}
    assert abs(got["a"].access - (first * at(0.1) + second * at(0.2))) < 1e-6 and got["a"].suppliers == 2
    assert abs(got["b"].access - (first * at(0.1) + second)) < 1e-6
    assert (got["far"].access, got["far"].band, got["far"].suppliers) == (0.0, "none", 0)
    # Nothing is lost: what cells within reach get, weighted by their demand, is all supply within reach of any.
    assert abs(10 * got["a"].access + 30 * got["b"].access - 10) < 1e-4
    assert catchment.catchment_access(cells.limit(0), supply).collect() == []


def test_nearest_measures_few_points_of_a_dense_cluster(spark, monkeypatch):
    rng = random.Random(3)
    # All in one cell of a sixteenth of a degree, as finely spread as positions are rounded.
    at = lambda: (round(6.0 + rng.random() * 0.01, 6), round(1.0 + rng.random() * 0.01, 6))
    points, places = [(i, *at()) for i in range(4000)], [(f"p{i}", *at()) for i in range(500)]
    measured, seen = geo._measured, []

    def watched(asked, few, here, group, k, key):
        seen.append(asked.join(few.join(here, ["row", "col"]), group).count())
        return measured(asked, few, here, group, k, key)

    monkeypatch.setattr(geo, "_measured", watched)
    table = spark.createDataFrame(points, "pk_unique_id long, lat double, lon double")
    found = geo.nearest_points(table, spark.createDataFrame(places, "place string, place_lat double, place_lon double"), 2)
    got = sorted((r.place, r.pk_unique_id, round(r.km, 5), r["rank"]) for r in found.collect())
    assert got == brute_nearest(points, places, 2)
    assert sum(seen) <= geo.FEW_POINTS * len(places)
