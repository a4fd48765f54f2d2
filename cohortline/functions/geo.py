"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

EARTH_KM = 6371.0


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in kilometres between two points in degrees."""
    lat1, lng1, lat2, lng2 = (c if isinstance(c, Column) else col(c) for c in (lat1, lng1, lat2, lng2))
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng / 2) * F.sin(dlng / 2))
    return F.lit(EARTH_KM) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
