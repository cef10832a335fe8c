"""Side-by-side comparison of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["query_id", "doc_id"]


def compare_hits(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every document in either ranking with both ranks, both scores and their differences."""
    a = left.select(*KEYS, F.col("rank").alias("left_rank"), F.col("score").alias("left_score"))
    b = right.select(*KEYS, F.col("rank").alias("right_rank"), F.col("score").alias("right_score"))
    return a.join(b, KEYS, "full").select(
        *KEYS,
        "left_rank",
        "right_rank",
        "left_score",
        "right_score",
        (F.col("right_rank") - F.col("left_rank")).alias("rank_delta"),
        (F.col("right_score") - F.col("left_score")).alias("score_delta"),
    )


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per query: ranking sizes, shared documents and the largest score difference."""
    both = F.col("left_rank").isNotNull() & F.col("right_rank").isNotNull()
    return (
        compare_hits(left, right)
        .groupBy("query_id")
        .agg(
            F.count("left_rank").alias("left_hits"),
            F.count("right_rank").alias("right_hits"),
            F.count(F.when(both, 1)).alias("shared"),
            F.max(F.abs("score_delta")).alias("max_score_delta"),
        )
    )
