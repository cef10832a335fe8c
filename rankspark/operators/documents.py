"""Shaping a corpus: fields, filters, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import with_positions


def as_fields(df: DataFrame, doc_id: str, fields: dict[str, str]) -> DataFrame:
    """One row per document and field from a table with one column per field."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("field"), F.col(column).alias("text")) for name, column in fields.items()]
    )
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.inline(pairs))


def min_length(df: DataFrame, column: str = "text", longer_than: int = 15) -> DataFrame:
    return df.filter(F.length(column) > longer_than)


def assign_ids(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Dense ids 0, 1, 2, … in ``order``, which should end in a unique key."""
    return with_positions(df, order, name)


def segment_offsets(df: DataFrame, segment: str) -> DataFrame:
    """``(segment, n_docs, base)``: the first global id of every segment."""
    sizes = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n_docs"))
    return with_positions(sizes, [F.col(segment)], "_no", {"n_docs": "base"}).drop("_no")
