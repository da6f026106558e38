"""Demand against supply: two-step floating catchment areas with distance decay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import KEY
from .geo import within_km


def demand_cells(demand: DataFrame, degrees: float = 0.1) -> DataFrame:
    """Demand (lat, lon, demand) summed over cells: place, place_lat, place_lon (the cell's middle) and demand.

    People without a position are left out.
    """
    row, col = F.floor(F.col("lat") / degrees), F.floor(F.col("lon") / degrees)
    cells = demand.where("lat is not null and lon is not null").groupBy(row.alias("row"), col.alias("col")).agg(
        F.sum("demand").alias("demand"))
    return cells.select(
        F.concat_ws(":", "row", "col").alias("place"), F.round((F.col("row") + 0.5) * degrees, 6).alias("place_lat"),
        F.round((F.col("col") + 0.5) * degrees, 6).alias("place_lon"), "demand")


def decay(km: Column, reach: float) -> Column:
    """Gaussian weight: 1 on the spot, 0 at the end of the reach."""
    edge = math.exp(-0.5)
    return (F.exp(-0.5 * (km / reach) * (km / reach)) - edge) / (1 - edge)


def catchment_access(
    cells: DataFrame, supply: DataFrame, reach: float = 60.0, low: float = 0.5, key: str = KEY,
) -> DataFrame:
    """Supply per unit of demand that each cell of demand can reach, and whether that is too little.

    ``cells`` as from ``demand_cells``; ``supply`` has key, lat, lon and supply. First every supplier's supply is divided
    by the demand within its reach, near demand counting more (``decay``); then the shares of all suppliers within a
    cell's reach are summed up with the same weights. ``band`` is ``none`` without a supplier, ``low`` under ``low`` times
    what all supply would be per unit of all demand, else ``served``. Pairs are met by grid cell and made once.
    """
    cells = stored(cells, "demand")
    offered = stored(supply.where("supply > 0 and lat is not null and lon is not null"), "supply")
    pairs = within_km(offered, cells, reach, key).select("place", key, "supply", decay(F.col("km"), reach).alias("weight"))
    pairs = stored(pairs, "catchments")
    load = pairs.join(cells.select("place", "demand"), "place").groupBy(key).agg(
        F.sum(F.col("demand") * F.col("weight")).alias("load"))
    share = pairs.join(load.where("load > 0"), key).groupBy("place").agg(
        F.sum(F.col("supply") / F.col("load") * F.col("weight")).alias("access"), F.count("*").alias("suppliers"))
    even = offered.agg(F.sum("supply")).first()[0] or 0
    asked = cells.agg(F.sum("demand")).first()[0] or 0
    limit = low * float(even) / float(asked) if asked else 0.0
    access = F.coalesce("access", F.lit(0.0))
    return cells.join(share, "place", "left").select(
        "place", "place_lat", "place_lon", "demand", F.coalesce("suppliers", F.lit(0)).cast("bigint").alias("suppliers"),
        F.round(access, 6).alias("access"),
        F.when(F.col("suppliers").isNull(), "none").when(access < limit, "low").otherwise("served").alias("band"))
