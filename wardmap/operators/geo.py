"""Positions, radius search and coverage gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import Grid, cell_of, cell_radius, haversine_km, jitter
from ..functions.values import blank_to_null
from ..session import stored
from ..sources.dimensions import REGION_COORDS, district_aliases
from ..sources.tables import KEY

REGION = "address_stateOrRegion"


def resolve_region(c: Column) -> Column:
    """Known region for a region text: its own name, else the longest district word in it.

    Words are matched whole, so "Bono East" is not taken for "Bono" and "ho" is not found
    inside other words; texts without any known word give NULL.
    """
    text = blank_to_null(c)
    words = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    names = F.map_from_arrays(
        F.array(*[F.lit(n.lower()) for n, _, _ in REGION_COORDS]), F.array(*[F.lit(n) for n, _, _ in REGION_COORDS])
    )
    aliases = F.array(*[
        F.struct(F.lit(f" {alias} ").alias("alias"), F.lit(region).alias("region"))
        for alias, region in district_aliases()
    ])
    first = F.filter(aliases, lambda a: F.contains(words, a["alias"]))
    return F.coalesce(F.try_element_at(names, F.lower(text)), F.get(first, F.lit(0))["region"])


def region_point(region: Column, part: str) -> Column:
    """``lat`` or ``lon`` of a known region's centroid."""
    column = {"lat": 1, "lon": 2}[part]
    points = F.map_from_arrays(
        F.array(*[F.lit(r[0]) for r in REGION_COORDS]), F.array(*[F.lit(r[column]) for r in REGION_COORDS])
    )
    return F.try_element_at(points, region)


def region_coordinates(f: DataFrame) -> DataFrame:
    """Each region text of the table with its known region and centroid."""
    return (
        f.groupBy(REGION).agg(F.count("*").alias("facilities"))
        .withColumn("known_region", resolve_region(F.col(REGION)))
        .withColumn("lat", region_point(F.col("known_region"), "lat"))
        .withColumn("lon", region_point(F.col("known_region"), "lon"))
    )


def located(f: DataFrame, key: str = KEY) -> DataFrame:
    """Facilities at their region's centroid plus a fixed offset of up to 0.15 degrees.

    Facilities without a known region have no position and are left out.
    """
    region = f.withColumn("known_region", resolve_region(F.col(REGION))).where(F.col("known_region").isNotNull())
    return region.withColumn(
        "lat", F.round(region_point(F.col("known_region"), "lat") + jitter(F.col(key), "lat"), 6)
    ).withColumn("lon", F.round(region_point(F.col("known_region"), "lon") + jitter(F.col(key), "lon"), 6))


#: Places: a literal list of (place, lat, lon), or a table with place, place_lat and place_lon.
Places = list[tuple[str, float, float]] | DataFrame


def place_table(spark: SparkSession, places: Places) -> DataFrame:
    if isinstance(places, DataFrame):
        return places.select("place", "place_lat", "place_lon")
    return spark.createDataFrame(places, "place string, place_lat double, place_lon double")


def within_km(points: DataFrame, places: Places, km: float, key: str = KEY) -> DataFrame:
    """Points within ``km`` of places, with the distance.

    Each place is spread to the grid cells within reach and joined by cell, so only points of nearby cells are
    measured. Spark picks the join by the size of the places.
    """
    grid = Grid(km)
    named = place_table(points.sparkSession, places)
    cells = named.select("*", F.inline(grid.neighbours(F.col("place_lat"), F.col("place_lon"))))
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    return (
        points.withColumn("cell_row", grid.row(F.col("lat"))).withColumn("cell_col", grid.col(F.col("lon")))
        .join(cells, ["cell_row", "cell_col"])
        .withColumn("km", distance)
        .where(F.col("km") <= km)
        .drop("cell_row", "cell_col", "place_lat", "place_lon")
    )


def count_within_km(points: DataFrame, places: Places, km: float) -> DataFrame:
    """Facilities within ``km`` per place, with the nearest distance; 0 where there is none."""
    found = within_km(points, places, km).groupBy("place").agg(
        F.count("*").alias("n"), F.min("km").alias("nearest")
    )
    return place_table(points.sparkSession, places).join(found, "place", "left").select(
        "place", F.coalesce("n", F.lit(0)).cast("bigint").alias("facilities"),
        F.round("nearest", 6).alias("nearest_km"),
    )


def cold_spots(points: DataFrame, places: Places, km: float) -> DataFrame:
    """Places without any of the points within ``km``."""
    near = within_km(points, places, km).select("place").distinct()
    named = place_table(points.sparkSession, places).withColumnsRenamed({"place_lat": "lat", "place_lon": "lon"})
    return named.join(near, "place", "left_anti")


#: Levels of the cell hierarchy that a search goes down, at most; a cell of level n is 180 / 2**n degrees wide.
LEVELS = tuple(range(2, 25, 2))
#: Points left for a cell of places at which they are measured one by one.
FEW_POINTS = 256


def _at_level(level: int, finest: int, row: str = "row", col: str = "col") -> list[Column]:
    """The cell of a level that a cell of the finest level lies in."""
    return [F.shiftright(c, finest - level).alias(c) for c in (row, col)]


def _parts(cells: DataFrame, row: str, col: str, step: int) -> DataFrame:
    """The cells ``step`` levels further down in place of the cells ``row`` and ``col``."""
    parts = F.sequence(F.lit(0), F.lit((1 << step) - 1))
    cells = cells.withColumn(row, F.explode(F.transform(parts, lambda i: F.shiftleft(row, step) + i)))
    return cells.withColumn(col, F.explode(F.transform(parts, lambda i: F.shiftleft(col, step) + i)))


def nearest_points(
    points: DataFrame, places: Places, k: int = 1, key: str = KEY, levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """The ``k`` points (key, lat, lon) nearest to each place at any distance: place, key, km and rank, ties by key.

    The search goes down a hierarchy of cells with the places of a cell together. The cells that hold ``k`` points for
    sure bound the distance of the ``k``-th from any place of the cell; cells that begin beyond the bound are dropped. A
    cell of places for which at most ``FEW_POINTS`` points are left (or of the last level) is done: its places are
    measured against these. The others are split further, both the places and the points, so cells get as small as the
    points are dense and a place meets a bounded number of points. Of points at one position only the ``k`` first by key
    can count. Places or points without a position have no rows.
    """
    spark, last = points.sparkSession, levels[-1]
    here = points.select(key, "lat", "lon").where("lat is not null and lon is not null")
    first = Window.partitionBy("lat", "lon").orderBy(key)
    here = here.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")
    here = stored(here.select("*", *cell_of(last, F.col("lat"), F.col("lon"))), "points")
    named = place_table(spark, places).where("place_lat is not null and place_lon is not null").dropDuplicates(["place"])
    from_row, from_col = cell_of(last, F.col("place_lat"), F.col("place_lon"))
    named = stored(named.select("*", from_row.alias("from_row"), from_col.alias("from_col")), "places")

    def asked(level: int) -> DataFrame:
        return named.select("place", "place_lat", "place_lon", *_at_level(level, last, "from_row", "from_col"))

    group, top = ["from_row", "from_col"], 1 << levels[0]
    every = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(top) for c in range(2 * top)])
    found = asked(levels[0]).select(*group).distinct().select(*group, F.inline(every), F.lit(float("inf")).alias("bound"))
    measured = []
    for n, level in enumerate(levels):
        counts = here.groupBy(*_at_level(level, last)).agg(F.count("*").alias("n"))
        if n:
            step = level - levels[n - 1]
            # Only the parts that hold places.
            own = asked(level).select(*group).distinct().select(
                *group, *[F.shiftright(c, step).alias(f"up_{c}") for c in group])
            found = found.withColumnsRenamed({c: f"up_{c}" for c in group}).join(own, [f"up_{c}" for c in group])
            found = _parts(found.drop(*[f"up_{c}" for c in group]), "row", "col", step)
        width = 180.0 / (1 << level)
        middles = [(F.col(c) + 0.5) * width - start for c, start in
                   (("from_row", 90.0), ("from_col", 180.0), ("row", 90.0), ("col", 180.0))]
        around = cell_radius(middles[0], width) + cell_radius(middles[2], width)
        found = found.withColumn("apart", haversine_km(*middles)).withColumn("around", around)
        found = found.withColumn("far", F.col("apart") + F.col("around")).withColumn("near", F.col("apart") - F.col("around"))
        found = found.drop("apart", "around").where("near <= bound")
        found = found.join(counts, ["row", "col"])
        held = F.sum("n").over(Window.partitionBy(*group).orderBy("far").rowsBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy(*group))
        found = found.withColumn("held", held).withColumn("bound", F.least("bound", F.coalesce(reach, "bound")))
        found = found.where("near <= bound").withColumn("left", F.sum("n").over(Window.partitionBy(*group)))
        found = stored(found.select(*group, "row", "col", "bound", "left"), "search-cells")
        done = F.lit(True) if level == last else F.col("left") <= FEW_POINTS
        few = found.where(done)
        if not few.isEmpty():
            measured.append(_measured(asked(level), few, here.select(
                key, "lat", "lon", *_at_level(level, last)), group, k, key))
        found = found.where(~done).drop("left")
        if found.isEmpty():
            break
    result = reduce(DataFrame.unionByName, measured) if measured else named.crossJoin(here).limit(0).select(
        "place", key, F.lit(0.0).alias("km"))
    order = Window.partitionBy("place").orderBy("km", key)
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _measured(places: DataFrame, few: DataFrame, points: DataFrame, group: list[str], k: int, key: str) -> DataFrame:
    """place, key and km of the ``k`` nearest among each ``FEW_POINTS`` points or so that are left for its cell."""
    lot = F.pmod(F.xxhash64(key), F.ceil(F.col("left") / FEW_POINTS))
    lots = few.join(points, ["row", "col"]).groupBy(*group, lot.alias("lot")).agg(
        F.collect_list(F.struct(key, "lat", "lon")).alias("points"))
    km = lambda p: haversine_km(p["lat"], p["lon"], F.col("place_lat"), F.col("place_lon"))
    nearest = F.slice(F.array_sort(F.transform("points", lambda p: F.struct(km(p).alias("km"), p[key].alias(key)))), 1, k)
    return places.join(lots, group).select("place", F.inline(nearest)).select("place", key, "km")
