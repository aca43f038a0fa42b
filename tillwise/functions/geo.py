"""Great-circle distance and what it says about exposure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions.core import d

EARTH_RADIUS_M = 6_371_000.0
EXPOSURE_SCALE_M = 500.0
METERS_PER_DEGREE = 111_194.9


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2.0), d(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2.0), d(2))
    return d(EARTH_RADIUS_M) * (2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a)))


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def geo_exposure(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(status, distance_m, exposure); a missing or impossible point exposes nothing."""
    missing = lat1.isNull() | lon1.isNull() | lat2.isNull() | lon2.isNull()
    good = ~missing & valid_point(lat1, lon1) & valid_point(lat2, lon2)
    distance = F.when(good, haversine_m(lat1, lon1, lat2, lon2))
    status = F.when(missing, "EXCLUDED_DUE_TO_MISSING_GEO").when(~good, "EXCLUDED_DUE_TO_INVALID_GEO").otherwise("CALCULATED")
    return F.struct(status.alias("status"), distance.alias("distance_m"),
                    F.coalesce(F.exp(-distance / EXPOSURE_SCALE_M), d(0)).alias("exposure"))
