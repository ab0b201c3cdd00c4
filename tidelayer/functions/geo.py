"""Planar distance and positions along a route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0  # fixed value


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.sqrt(dlat * dlat + dlon * dlon) * F.lit(KM_PER_DEGREE)


def between(start: Column, end: Column, progress: Column) -> Column:
    """Linear position at a progress of 0 to 1."""
    return start + (end - start) * progress
