"""Points for distance ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_from_columns(df: DataFrame, doc_id: str, x: str, y: str) -> DataFrame:
    """``(doc_id, x, y)`` as doubles."""
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    )


def points_from_vectors(df: DataFrame, doc_id: str, vector: str) -> DataFrame:
    """The first two components of a vector column as coordinates."""
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(vector)[0].cast("double").alias("x"),
        F.col(vector)[1].cast("double").alias("y"),
    )
