"""A table is streamed whole, whether it is one file or a folder of files."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from rankspark.plans import queries as Q


@pytest.mark.parametrize("files", [1, 3])
def test_folder_and_file(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"word{i % 7} common {'x' * (i % 3)}") for i in range(60)] + [(60, None)], "doc_id long, text string")
    folder = "documents.parquet" if files > 1 else "written"
    rows.repartition(files).write.parquet(f"{tmp_path}/{folder}")
    if files == 1:
        shutil.copy(glob.glob(f"{tmp_path}/written/part-*")[0], f"{tmp_path}/documents.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/other.parquet")
    got = {r["term"]: r["df"] for r in Q.stream_ingest(spark, str(tmp_path)).collect()}
    words = rows.select(F.explode(F.array_distinct(F.split("text", " "))).alias("term")).where("term <> ''")
    assert got == {r["term"]: r["count"] for r in words.groupBy("term").count().collect()}
