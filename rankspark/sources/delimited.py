"""Text corpora in CSV: plain, gzip or zip."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import number_in_place
from .records import read_numbered_records, read_records

TEXT_COLUMN = 2
ZIP_BATCH = 10_000
CORRUPT = "_corrupt"
#: Endings of files that cannot be cut: one task reads such a file whatever is done.
WHOLE_FILES = (".gz", ".zip", ".deflate", ".lz4", ".snappy", ".zst")


def read_csv_corpus(
    spark: SparkSession,
    path: str,
    text_column: int = TEXT_COLUMN,
    multi_line: bool = True,
    partitions: int | None = None,
    escape: str = '"',
) -> DataFrame:
    """``(text)``: one column of every record after the header record.

    Records too short to have the column are dropped; empty texts stay. The
    compression follows from the file name. ``multi_line`` allows newlines in
    quoted fields; files that can be cut are read by many tasks either way (see
    :mod:`.records`; quotes must then stand around whole fields, as the format
    asks, and lines end in ``\\n`` or ``\\r\\n``). ``partitions`` spreads the rows after reading, which pays off
    for a few large compressed files. ``escape`` is what a quote inside quotes
    stands behind: another quote, or a backslash.
    """
    files = _cut_files(spark, path) if multi_line else None
    if files:
        rows = _texts(read_records(spark, files, text_column + 1, escape), text_column, escape)
    else:
        rows = _read(spark, path, text_column, multi_line, escape).select("text")
    return rows.repartition(partitions) if partitions else rows


def read_numbered_csv_corpus(
    spark: SparkSession,
    path: str,
    text_column: int = TEXT_COLUMN,
    multi_line: bool = True,
    limit: int | None = None,
    escape: str = '"',
) -> DataFrame:
    """``(doc_id, text)``: the same records with their ordinals in file order.

    ``limit`` keeps the first so many records. Splits are counted first and
    numbered where they are read; texts are neither sorted nor stored.
    """
    files = _cut_files(spark, path) if multi_line else None
    if files:
        records = read_numbered_records(spark, files, text_column + 1, escape, limit)
        return _texts(records, text_column, escape, F.col("doc_id"))
    rows = _read(spark, path, text_column, multi_line, escape)
    return number_in_place(rows, "doc_id", limit).select("doc_id", "text")


def _cut_files(spark: SparkSession, path: str) -> list[str] | None:
    """The files under ``path`` if tasks can share them."""
    if path.endswith(".zip"):
        return None
    files = spark.read.text(path).inputFiles()
    return None if all(f.endswith(WHOLE_FILES) for f in files) else files


def _schema(text_column: int) -> T.StructType:
    names = [f"c{i}" for i in range(text_column)] + ["text"]
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _texts(records: DataFrame, text_column: int, escape: str, *more: Column) -> DataFrame:
    """The text column of whole records that are known to have it."""
    options = {"quote": '"', "escape": escape, "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"}
    options |= {"columnNameOfCorruptRecord": CORRUPT}
    fields = F.from_csv("value", _schema(text_column).simpleString(), options)
    return records.select(*more, F.coalesce(fields["text"], F.lit("")).alias("text"))


def _read(spark: SparkSession, path: str, text_column: int, multi_line: bool, escape: str) -> DataFrame:
    """``(text, _file, _block)``."""
    if path.endswith(".zip"):
        return _read_zip(spark, path, text_column, escape)
    return _read_plain(spark, path, text_column, multi_line, escape)


def _read_plain(spark: SparkSession, path: str, text_column: int, multi_line: bool, escape: str) -> DataFrame:
    rows = spark.read.csv(
        path,
        schema=_schema(text_column),
        header=True,
        enforceSchema=True,
        multiLine=multi_line,
        quote='"',
        escape=escape,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
        maxCharsPerColumn=-1,
    )
    # A record that differs from the schema's width is kept when it has enough
    # separators outside quotes, i.e. when its text is empty rather than absent.
    unquoted = F.regexp_replace(CORRUPT, r'"[^"]*"', "")
    wide_enough = F.regexp_count(unquoted, F.lit(",")) >= text_column
    present = F.col("text").isNotNull() | F.col(CORRUPT).isNull() | wide_enough
    return rows.filter(present).select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _read_zip(spark: SparkSession, path: str, text_column: int, escape: str) -> DataFrame:
    """First entry of every archive; an archive is one task's work and streams through it."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    entry = archive.namelist()[0]
                    with io.TextIOWrapper(archive.open(entry), encoding="utf-8", newline="") as lines:
                        records = csv.reader(lines, doublequote=escape == '"', escapechar=None if escape == '"' else escape)
                        next(records, None)
                        texts: list[str] = []
                        for record in records:
                            if len(record) > text_column:
                                texts.append(record[text_column])
                            if len(texts) == ZIP_BATCH:
                                yield pd.DataFrame({"text": texts, "_file": file, "_block": 0})
                                texts = []
                        if texts:
                            yield pd.DataFrame({"text": texts, "_file": file, "_block": 0})

    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInPandas(parse, "text string, _file string, _block long")
