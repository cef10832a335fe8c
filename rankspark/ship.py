"""Giving this package to executors that do not have it installed."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from .operators.scale import scratch_dir


def ship(spark: SparkSession) -> str:
    """Put the package as a zip file under the shared scratch folder and have every executor import from it.

    Needed once per session, and only for ``rankspark.llm`` on executors that
    cannot import the package: all else sends its functions along.
    """
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("rankspark", os.path.relpath(path, root)))
    path = f"{scratch_dir(spark)}/rankspark.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    spark.sparkContext.addPyFile(path)
    return path
