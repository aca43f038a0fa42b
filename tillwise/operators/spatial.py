"""Radius search between stores and dated notices over a degree grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.core import d
from tillwise.functions.geo import METERS_PER_DEGREE, haversine_m
from tillwise.functions.skew import salted_join

SLACK = 1.01


def _row_of(lat: Column, radius_m: float) -> Column:
    return F.floor(lat * METERS_PER_DEGREE / radius_m).cast("bigint")


def _column_of(lon: Column, row: Column, radius_m: float) -> Column:
    """Column inside a grid row; a row's cells are as wide as the radius at its poleward edge."""
    edge = F.greatest(F.abs(row), F.abs(row + 1)) * (radius_m / METERS_PER_DEGREE)
    shrink = F.greatest(d(0.01), F.cos(F.radians(F.least(edge, d(89.0)))))
    width = SLACK * radius_m / METERS_PER_DEGREE / shrink
    return F.floor(lon / width).cast("bigint")


def radius_points(stores: DataFrame, events: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """(store_id, lat, lon, event_count, distance_m): event points within the radius of a store.

    Events at one point (and stores at one point) collapse to one row before they meet, so a
    crowded point costs one comparison. Cells of the grid are spread over several tasks."""
    points = events.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count("*").alias("event_count"))
    points = points.withColumn("_row", _row_of(F.col("lat"), radius_m)).withColumn("_col", _column_of(F.col("lon"), F.col("_row"), radius_m))
    homes = stores.select(F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon")).distinct()
    near = F.sequence(F.lit(-1), F.lit(1))
    cells = homes.withColumn("_dr", F.explode(near)).withColumn("_row", _row_of(F.col("home_lat"), radius_m) + F.col("_dr"))
    cells = cells.withColumn("_dc", F.explode(near)).withColumn("_col", _column_of(F.col("home_lon"), F.col("_row"), radius_m) + F.col("_dc"))
    met = salted_join(points, cells.drop("_dr", "_dc"), ["_row", "_col"], F.struct("lat", "lon"))
    distance = haversine_m(F.col("home_lat"), F.col("home_lon"), F.col("lat"), F.col("lon"))
    hits = met.withColumn("distance_m", distance).filter(F.col("distance_m") <= radius_m)
    owners = stores.select("store_id", F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon"))
    return owners.join(hits, ["home_lat", "home_lon"]).select("store_id", "lat", "lon", "event_count", "distance_m")


#: cells across a radius in the grid of the summary
FINE = 8


def _width_of(row: Column, cell_m: float) -> Column:
    """Width in degrees of the cells of a grid row (see _column_of)."""
    edge = F.greatest(F.abs(row), F.abs(row + 1)) * (cell_m / METERS_PER_DEGREE)
    return SLACK * cell_m / METERS_PER_DEGREE / F.greatest(d(0.01), F.cos(F.radians(F.least(edge, d(89.0)))))


def radius_summary(stores: DataFrame, events: DataFrame, radius_m: float = 1500.0) -> DataFrame:
    """(store_id, event_count, nearest_m) of every store: events within the radius, and the distance of the nearest of them
    (null where there is none).

    Cells of an eighth of the radius that lie wholly inside it count by their sum; only points of cells on its edge are
    measured. The nearest point lies in a cell that begins before the nearest filled cell ends, so only such
    cells are searched for it. One row a store comes out, and a store meets at most a few hundred cells."""
    cell_m = radius_m / FINE
    high = cell_m / METERS_PER_DEGREE
    points = events.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon").agg(F.count("*").alias("n"))
    points = points.withColumn("_row", _row_of(F.col("lat"), cell_m)).withColumn("_col", _column_of(F.col("lon"), F.col("_row"), cell_m))
    sums = points.groupBy("_row", "_col").agg(F.sum("n").alias("cell_n"))
    homes = stores.select(F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon")).where("home_lat is not null and home_lon is not null").distinct()
    home_row = _row_of(F.col("home_lat"), cell_m)
    cells = homes.withColumn("_row", F.explode(F.sequence(home_row - FINE - 1, home_row + FINE + 1))).withColumn("_w", _width_of(F.col("_row"), cell_m))
    home_col = F.floor(F.col("home_lon") / F.col("_w")).cast("bigint")
    cells = cells.withColumn("_col", F.explode(F.sequence(home_col - FINE - 1, home_col + FINE + 1)))
    place = lambda lat, lon: haversine_m(F.col("home_lat"), F.col("home_lon"), lat, lon)
    south, west = F.col("_row") * high, F.col("_col") * F.col("_w")
    corners = [place(south + i * high, west + j * F.col("_w")) for i in (0, 1) for j in (0, 1)]
    middle, half = place(south + high / 2, west + F.col("_w") / 2), cell_m * 0.75  # half a diagonal is 0.71 of a side
    cells = cells.withColumns({"_far": F.greatest(*corners) + 0.01 * cell_m, "_near": F.greatest(d(0), middle - half)}).where(F.col("_near") <= radius_m)
    met = salted_join(cells, sums, ["_row", "_col"], F.struct("home_lat", "home_lon")).select("home_lat", "home_lon", "_row", "_col", "_far", "_near", "cell_n")
    first = met.groupBy("home_lat", "home_lon").agg(F.min("_far").alias("_first"), F.sum(F.when(F.col("_far") <= radius_m, F.col("cell_n"))).alias("inside"))
    near = met.join(first, ["home_lat", "home_lon"]).where((F.col("_far") > radius_m) | (F.col("_near") <= F.col("_first")))
    measured = salted_join(points, near.select("home_lat", "home_lon", "_row", "_col", "_far"), ["_row", "_col"], F.struct("lat", "lon"))
    measured = measured.withColumn("_m", place(F.col("lat"), F.col("lon"))).where(F.col("_m") <= radius_m)
    edge = measured.groupBy("home_lat", "home_lon").agg(F.sum(F.when(F.col("_far") > radius_m, F.col("n"))).alias("edge"), F.min("_m").alias("nearest_m"))
    found = first.join(edge, ["home_lat", "home_lon"], "left")
    out = stores.select("store_id", F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon")).join(found, ["home_lat", "home_lon"], "left")
    return out.select("store_id", (F.coalesce("inside", F.lit(0)) + F.coalesce("edge", F.lit(0))).alias("event_count"), "nearest_m")
