"""From documents to postings and collection statistics.

``documents`` is ``(doc_id, text)``, optionally with ``field`` and ``segment``
columns that are carried along; one row per document and field.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bm25, text

CARRIED = ("field", "segment")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in df.columns] + ["doc_id"]


def _group(df: DataFrame) -> list[str]:
    return ["field"] if "field" in df.columns else []


def tokenize(documents: DataFrame, analyzer: str = "standard", stop_words: Iterable[str] = ()) -> DataFrame:
    """``(doc_id, tokens)``: every document with its token array."""
    return documents.select(*_keys(documents), text.tokens("text", analyzer, stop_words).alias("tokens"))


def doc_lengths(tokenized: DataFrame) -> DataFrame:
    """``(doc_id, dl)``: number of tokens after stop words."""
    return tokenized.select(*_keys(tokenized), F.size("tokens").alias("dl"))


def build_postings(
    tokenized: DataFrame, keep_empty: bool = False, only: Iterable[str] | None = None
) -> DataFrame:
    """``(doc_id, term, tf, dl)``, one row per document and distinct term; no shuffle.

    With ``keep_empty`` a document without tokens keeps one row whose term is
    null. ``only`` drops other terms before counting; lengths stay whole.
    """
    keys = _keys(tokenized)
    words = F.col("tokens") if only is None else F.filter("tokens", lambda t: t.isin(list(only)))
    rows = tokenized.select(*keys, F.size("tokens").alias("dl"), words.alias("words"))
    counted = rows.select(*keys, "dl", text.term_counts("words").alias("counts"))
    # The outer form in both cases: for the inner one the optimizer pushes a
    # "not empty" check below the projection, which would tokenize a second time.
    rows = counted.select(*keys, "dl", F.explode_outer("counts").alias("p")).select(
        *keys, F.col("p.term").alias("term"), F.col("p.tf").alias("tf"), "dl"
    )
    return rows if keep_empty else rows.filter(F.col("term").isNotNull())


def collection_stats(lengths: DataFrame) -> DataFrame:
    """``(n_docs, sum_ttf, avgdl)`` per field; documents without tokens do not count."""
    grouped = lengths.groupBy(*_group(lengths)).agg(
        F.count(F.when(F.col("dl") > 0, 1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("sum_ttf"),
    )
    return grouped.withColumn("avgdl", F.col("sum_ttf") / F.nullif(F.col("n_docs"), F.lit(0)))


def doc_freq(postings: DataFrame) -> DataFrame:
    """``(term, df)`` per field, pre-aggregated before the shuffle."""
    return postings.groupBy(*_group(postings), "term").agg(F.count(F.lit(1)).alias("df"))


def norm_length(dl: Column, quantize: bool, use_norms: bool = True) -> Column:
    """The length that enters a document's norm."""
    if not use_norms:
        return F.lit(1)
    return bm25.quantize_length(dl) if quantize else dl


def keep_terms(df: DataFrame, vocabulary: DataFrame | Iterable[str] | None) -> DataFrame:
    """Rows whose term is whitelisted; ``None`` or an empty list keeps everything."""
    if vocabulary is None:
        return df
    if isinstance(vocabulary, DataFrame):
        # A join inside Spark: unlike an empty list, an empty table keeps nothing.
        return df.join(vocabulary.select("term").distinct(), "term", "left_semi").select(*df.columns)
    words = list(vocabulary)
    return df.filter(F.col("term").isin(words)) if words else df


def posting_lists(postings: DataFrame) -> DataFrame:
    """Size and extent of every term's posting list."""
    return postings.groupBy(*_group(postings), "term").agg(
        F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
