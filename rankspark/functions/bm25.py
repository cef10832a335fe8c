"""BM25 arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def quantize_length(dl: Column) -> Column:
    """Document length as the one-byte length code keeps it.

    Exact below 40; from there 4 significant bits of ``dl - 24``, floored.
    """
    over = dl - 24
    lost_bits = F.length(F.bin(over)) - 4
    kept = F.call_function("shiftleft", F.call_function("shiftright", over, lost_bits), lost_bits)
    return F.when(dl < 40, dl).otherwise(kept + 24)


def length_norm(length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / avgdl)


def saturation(tf: Column, norm: Column, k1: float = K1) -> Column:
    """The part of a partial score that depends on the document only."""
    return F.lit(k1 + 1) * tf / (tf + norm)


def partial_score(tf: Column, norm: Column, idf_: Column, k1: float = K1) -> Column:
    return idf_ * saturation(tf, norm, k1)


def rank_key(score: Column) -> Column:
    """What ranking compares: the score to seven digits, whatever its size.

    Equal scores summed in another order still tie and fall back to the document id.
    """
    return score.cast("float")
