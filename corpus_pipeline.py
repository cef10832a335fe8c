"""A training corpus from raw documents, stage by stage.

Every stage takes all documents its predecessor kept and hands on the columns of
``documents``; the last one returns what the mix takes of each document. A null
text counts as empty in every stage, texts are read whole however long, a null
source is a source of its own, an empty table stays empty, and other columns,
whatever their names, are handed on untouched (the last stage leaves them out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm import decontamination, mixing, pii, simhash_dedup, toxicity
from rankspark.llm.common import fresh, quoted, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger rejects go.

    Every row is judged by its own text, so rows that are equal or tie share their fate; empty texts are scored like any other.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, spans = fresh(docs, "_toxic_score"), fresh(docs, "_toxic_spans")
    scored = toxicity.score(docs, model, score_col=score, spans_col=spans)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*quoted(docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least id, rows without id last, of equal rows one.

    Empty and wordless texts are copies of each other.
    """
    return simhash_dedup.drop_near_duplicates(docs, shingle_words=3, radius=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Empty documents hold none; items under five words match nothing; repeated documents go or stay together.
    """
    leaks = fresh(docs, "_leaks")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), hits_col=leaks)
    return found.where(F.size(leaks) == 0).select(*quoted(docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers and dates become pseudonyms, equal ones the same; n_chars follows the text (null for a null one)."""
    return pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every row; repeated rows count each, empty ones give nothing."""
    _, documents = mixing.mix(docs)
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
]

#: Hashes, a fitted classifier and components are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
