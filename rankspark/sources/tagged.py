"""Corpora whose records are tagged lines or web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_abstract, clean_title
from ..operators.documents import min_length
from ..operators.scale import broadcast_if_small, cut_lineage

MIN_LENGTH = 15


def read_abstracts(spark: SparkSession, path: str, longer_than: int = MIN_LENGTH, one_dump: bool = False) -> DataFrame:
    """``(title, desc)`` from a dump with title and abstract lines.

    Every abstract line gives a row, with the last title line before it in its
    file, in whatever record that was (an empty title if there is none);
    ``one_dump`` reads all files as one, in the order of their names. Text
    between tags is kept as it stands, entities included. Records need no ends:
    lines are dealt out by split, and every split begins with the last title of
    the splits before it, one row each.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("_text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    # A tag must start its line.
    title = F.when(F.col("_text").startswith("<title>"), F.col("_text"))
    lines = lines.where(F.col("_text").startswith("<title>") | F.col("_text").startswith("<abstract>"))
    lines = lines.withColumn("_line", F.monotonically_increasing_id()).withColumn("_title", title)

    last = lines.where("_title is not null").groupBy("_file", "_block").agg(F.max_by("_title", "_line").alias("_last"))
    splits = cut_lineage(lines.select("_file", "_block").distinct().join(last, ["_file", "_block"], "left"))
    ordered = Window.orderBy("_file", "_block") if one_dump else Window.partitionBy("_file").orderBy("_block")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("_file", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))

    # Within a split, which bounds what a task holds of one file.
    so_far = Window.partitionBy("_file", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("_title", F.last("_title", ignorenulls=True).over(so_far))
    found = named.where(F.col("_text").startswith("<abstract>")).join(broadcast_if_small(carried), ["_file", "_block"], "left")
    title = F.coalesce("_title", "_carried", F.lit(""))
    cleaned = found.select(clean_title(title).alias("title"), clean_abstract(F.col("_text")).alias("desc"))
    return min_length(cleaned, "desc", longer_than)


def read_xml_abstracts(spark: SparkSession, path: str, longer_than: int = MIN_LENGTH) -> DataFrame:
    """``(title, desc)`` from well-formed XML, entities decoded."""
    docs = (
        spark.read.format("xml")
        .option("rowTag", "doc")
        .schema("title string, url string, abstract string")
        .load(path)
    )
    named = docs.select(clean_title("title").alias("title"), F.col("abstract").alias("desc"))
    return min_length(named.filter(F.col("desc").isNotNull()), "desc", longer_than)


def page_fields(pages: DataFrame) -> DataFrame:
    """``(page_id, title, desc)`` from raw HTML: the title element and the text of the page."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.col("html")
    for element in ("script", "style", "head"):  # one after the other: none ends another, and <header> is none of them
        body = F.regexp_replace(body, rf"(?is)<{element}\b[^>]*>.*?</{element}\s*>", " ")
    desc = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", title.alias("title"), desc.alias("desc"))
