"""Planar geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def planar_distance(x: Column, y: Column, x0: float, y0: float) -> Column:
    """Straight-line distance in the plane; coordinates are not taken as a sphere's."""
    dx = x.cast("double") - F.lit(float(x0))
    dy = y.cast("double") - F.lit(float(y0))
    return F.sqrt(dx * dx + dy * dy)
