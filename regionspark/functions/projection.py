"""WGS84 degrees to local metres: spherical Mercator, minus the origin, times cos(origin latitude)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sphere's radius in metres, and the latitude at which Mercator is cut off.
RADIUS = 6378137.0
MAX_LATITUDE = 85.051128779806604


def check_latitude(lat: Column) -> Column:
    """lat, or an error if it is not finite or beyond the cut-off."""
    bad = lat.isNull() | F.isnan(lat) | (F.abs(lat) > MAX_LATITUDE)
    return F.when(bad, F.raise_error(F.concat(F.lit("latitude out of range: "), F.coalesce(lat.cast("string"), F.lit("null")))).cast("double")).otherwise(lat)


def check_longitude(lon: Column) -> Column:
    """lon, or an error if it is not finite or beyond half a turn."""
    bad = lon.isNull() | F.isnan(lon) | (F.abs(lon) > 180)
    return F.when(bad, F.raise_error(F.concat(F.lit("longitude out of range: "), F.coalesce(lon.cast("string"), F.lit("null")))).cast("double")).otherwise(lon)


def origin(lon: Column, lat: Column) -> Column:
    """struct(lon, lat) of a projection's origin, or an error: it must lie on the map."""
    return F.struct(check_longitude(lon).alias("lon"), check_latitude(lat).alias("lat"))


def mercator_x(lon: Column) -> Column:
    return F.lit(RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(RADIUS) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def inverse_x(x: Column) -> Column:
    return F.degrees(x / RADIUS)


def inverse_y(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - F.pi() / 2)


def local_scale(origin_lat: Column) -> Column:
    return F.cos(F.radians(origin_lat))


def project_x(lon: Column, origin_lon: Column, origin_lat: Column) -> Column:
    return (mercator_x(lon) - mercator_x(origin_lon)) * local_scale(origin_lat)


def project_y(lat: Column, origin_lat: Column) -> Column:
    return (mercator_y(lat) - mercator_y(origin_lat)) * local_scale(origin_lat)


def unproject_x(x: Column, origin_lon: Column, origin_lat: Column) -> Column:
    return inverse_x(x / local_scale(origin_lat) + mercator_x(origin_lon))


def unproject_y(y: Column, origin_lat: Column) -> Column:
    return inverse_y(y / local_scale(origin_lat) + mercator_y(origin_lat))


def unproject_geometry(parts: Column, origin_lon: Column, origin_lat: Column) -> Column:
    """parts in local metres back in degrees."""
    point = lambda p: F.struct(unproject_x(p["x"], origin_lon, origin_lat).alias("x"), unproject_y(p["y"], origin_lat).alias("y"))
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def project_geometry(parts: Column, origin_lon: Column, origin_lat: Column) -> Column:
    """parts: array of rings of struct(x, y) in degrees, projected without changing its structure."""
    point = lambda p: F.struct(project_x(p["x"], origin_lon, origin_lat).alias("x"), project_y(p["y"], origin_lat).alias("y"))
    return F.transform(parts, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(a)) * 2 * RADIUS


def dataset_origin(boxes: DataFrame) -> DataFrame:
    """One row origin_lon, origin_lat: the middle of all boxes (lon0, lat0, w, h)."""
    found = boxes.agg(F.min("lon0").alias("a"), F.max(F.col("lon0") + F.col("w")).alias("b"), F.min("lat0").alias("c"), F.max(F.col("lat0") + F.col("h")).alias("d"))
    return found.select(((F.col("a") + F.col("b")) / 2).alias("origin_lon"), ((F.col("c") + F.col("d")) / 2).alias("origin_lat"))


def millimetres(x: Column) -> Column:
    """A length as whole millimetres, equal in every engine."""
    return F.floor(x * 1000 + 0.5).cast("long")
