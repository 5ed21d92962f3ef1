"""Spherical geometry as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km, rounded to two decimals."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = (half_lat * half_lat
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon)
    # Rounding may push antipodes just past 1; least() would turn null into 1.
    chord = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    arc = F.lit(2.0) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))
    return F.round(F.lit(float(EARTH_RADIUS_KM)) * arc, 2)


def cell_lat(lat="latitude") -> Column:
    """Latitude of the 0.001 degree cell, in whole millidegrees."""
    return F.round(_col(lat) * 1000).cast("bigint")


def cell_lon(lon="longitude") -> Column:
    return F.round(_col(lon) * 1000).cast("bigint")


def location_key(lat="latitude", lon="longitude") -> Column:
    """Display form of a location cell; joins use the integer pair instead."""
    return F.concat_ws("_", F.round(_col(lat), 3).cast("string"),
                       F.round(_col(lon), 3).cast("string"))


def unit_vector_means(lat="latitude", lon="longitude") -> dict[str, Column]:
    """Aggregates of the 3-D unit vectors whose direction is the mean centre."""
    lat, lon = F.radians(_col(lat)), F.radians(_col(lon))
    return {
        "mean_x": F.avg(F.cos(lat) * F.cos(lon)),
        "mean_y": F.avg(F.cos(lat) * F.sin(lon)),
        "mean_z": F.avg(F.sin(lat)),
    }


def center_lat(x="mean_x", y="mean_y", z="mean_z") -> Column:
    x, y, z = map(_col, (x, y, z))
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def center_lon(x="mean_x", y="mean_y") -> Column:
    return F.degrees(F.atan2(_col(y), _col(x)))


def unwrap_longitude(lon, spread, rows) -> Column:
    """Longitude on 0..360 when its group spans more than 180 degrees."""
    lon = _col(lon)
    wide = (_col(rows) > 1) & (_col(spread) > 180)
    return F.when(wide & (lon < 0), lon + 360).otherwise(lon)


def valid_coordinates(lat="latitude", lon="longitude") -> Column:
    """Inclusive range test; null and NaN coordinates are invalid."""
    inside = _col(lat).between(-90, 90) & _col(lon).between(-180, 180)
    return F.coalesce(inside, F.lit(False))
