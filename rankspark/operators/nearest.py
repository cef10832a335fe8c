"""Ranking points by planar distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import planar_distance
from .scale import take_first


def distances(points: DataFrame, x0: float, y0: float) -> DataFrame:
    """``(doc_id, dist)`` for every point ``(doc_id, x, y)``."""
    return points.select("doc_id", planar_distance(F.col("x"), F.col("y"), x0, y0).alias("dist"))


def nearest(points: DataFrame, x0: float, y0: float, k: int | None = None) -> DataFrame:
    """Points by distance ascending, all of them or the first ``k``."""
    order = [F.col("dist"), F.col("doc_id")]
    scored = distances(points, x0, y0)
    return scored.orderBy(*order) if k is None else take_first(scored, order, k)
