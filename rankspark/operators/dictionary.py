"""Term dictionary: dense ids and posting offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import with_positions


def term_dictionary(doc_freqs: DataFrame) -> DataFrame:
    """``(term, df, term_id, start, end)``: ids in term order, offsets as running totals of df.

    ``end`` is explicit, so the last term has one too.
    """
    order = [F.col(c) for c in ("field", "term") if c in doc_freqs.columns]
    out = with_positions(doc_freqs, order, "term_id", totals={"df": "start"})
    return out.withColumn("end", F.col("start") + F.col("df"))


def index_summary(doc_freqs: DataFrame) -> DataFrame:
    """``(n_terms, n_postings)`` of a dictionary."""
    return doc_freqs.agg(
        F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("n_postings")
    )
