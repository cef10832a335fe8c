"""Helpers that keep plans sound when keys are skewed or sides are large."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A side may be broadcast only when it is measured to stay within both limits.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024

# A term is "heavy" when it holds more than 1/HEAVY_SLOTS of all postings, so
# there are never more than HEAVY_SLOTS heavy terms, however large the corpus.
HEAVY_SLOTS = 10_000
HEAVY_TERM_BYTES = 1_024

# Up to this k the best k of a query are ranked in one task per query, from at
# most k candidates per input partition.
WINDOW_K = 1_000


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, shared by all executors.

    Under ``spark.checkpoint.dir`` when the cluster names one, else under the
    session's checkpoint folder. Only a local master may go without either, as
    in tests: there a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return tempfile.mkdtemp(prefix="rankspark-")
    jvm = spark.sparkContext._jvm
    return f"{base.rstrip('/')}/rankspark-{jvm.java.util.UUID.randomUUID().toString()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` when the input has fewer splits than there are cores.

    A no-op for a large corpus; for a few unsplittable files it keeps the
    analysis from running in as few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def measured_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven to fit a broadcast, reading at most ``max_rows + 1`` rows."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    row = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
        .first()
    )
    return row["rows"] <= max_rows and row["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if measured_small(df, max_rows) else df


def with_positions(df: DataFrame, order: list[Column], pos: str = "pos", totals: dict[str, str] | None = None) -> DataFrame:
    """Number all rows 0, 1, 2, … in ``order`` without a one-task global sort.

    Rows are range-partitioned and written once; each partition numbers its own
    rows and only the per-partition counts (one row per partition) are added up
    centrally. ``totals`` maps a value column to the name of a column for its
    running total over the preceding rows. ``order`` should end in a unique key:
    then a partition never has to hold a whole run of equal rows.
    """
    totals = totals or {}
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # Written before use: partition numbers must not change between the pass
    # that counts and the pass that numbers.
    ranged = cut_lineage(ranged).withColumn("_part", F.shiftright("_at", 33))

    sums = [F.sum(c).alias(f"_sum_{c}") for c in totals]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *sums)
    offsets = offsets.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in totals],
    )
    out = ranged.join(F.broadcast(offsets), "_part")
    out = out.withColumn(pos, F.col("_rows_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for column, name in totals.items():
        out = out.withColumn(name, F.col(f"_before_{column}") + F.coalesce(F.sum(column).over(inside), F.lit(0)))
    return out.select(*df.columns, pos, *totals.values())


def count_before(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Add how many of the preceding rows of the same task have ``flag``; nothing is exchanged.

    Rows are numbered, flagged ones doubled and all numbered again: the gap
    between a row's two numbers grows by one with every flagged row before it.
    """
    once = rows.withColumn("_once", F.monotonically_increasing_id())
    copies = F.when(flag, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = once.withColumn("_copy", F.explode(copies)).withColumn("_twice", F.monotonically_increasing_id())
    first = twice.where("_copy = 0")
    return first.withColumn(name, F.col("_twice") - F.col("_once")).drop("_once", "_copy", "_twice")


def small_or_raise(df: DataFrame, what: str) -> DataFrame:
    """``df`` marked for broadcast after its size was measured."""
    if not measured_small(df):
        raise ValueError(f"{what}: too many to broadcast; raise spark.sql.files.maxPartitionBytes")
    return F.broadcast(df)


def task_of(row_id: str) -> Column:
    """The task that gave a row its ``monotonically_increasing_id``."""
    return F.shiftright(row_id, 33)


#: What a row raises that was read by another task, or at another place, than when it was counted.
MOVED = "the input's splits have changed since they were counted; read it again"


def number_in_place(rows: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Number rows 0, 1, 2, … by file, split and place in it, from ``_file`` and ``_block``; nothing is exchanged or stored.

    A first reading counts the rows of every split (one row each), a second one
    adds what precedes the split. ``limit`` keeps the first so many rows, and of
    the files only those that hold them are read again.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    counted = cut_lineage(rows.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if limit is not None:
        bases = bases.where(F.col("_base") < limit)
        rows = rows.where(_in_files(bases))
    placed = rows.join(small_or_raise(bases, "splits of the input"), ["_file", "_block"], "left" if limit is None else "inner")
    at = F.col("_row") - F.col("_first")
    sound = (at >= 0) & (at < F.col("_n"))
    numbered = placed.withColumn(name, F.when(sound, F.col("_base") + at).otherwise(F.raise_error(F.lit(MOVED)).cast("long")))
    return (numbered if limit is None else numbered.where(F.col(name) < limit)).drop("_row", "_first", "_n", "_base")


#: Files that are named in a plan; more are told apart row by row.
NAMED_FILES = 1_000


def _in_files(splits: DataFrame) -> Column:
    """A condition that leaves out whole files before they are opened."""
    names = [row[0] for row in splits.select("_file").distinct().limit(NAMED_FILES + 1).collect()]
    return F.col("_file").isin(names) if len(names) <= NAMED_FILES else F.lit(True)


def take_first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, for any ``n``."""
    if n <= 0:
        return df.limit(0)
    if n <= WINDOW_K:
        return df.orderBy(*order).limit(n)
    return with_positions(df, order, "_pos").filter(F.col("_pos") < n).orderBy("_pos").drop("_pos")


def join_term_stats(
    postings: DataFrame,
    dictionary: DataFrame,
    on: list[str],
    n_postings: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add a dictionary's columns to every posting, whatever the term skew.

    A small dictionary is broadcast. Otherwise heavy terms, bounded in number
    by ``HEAVY_SLOTS`` and holding the bulk of all postings, are broadcast and
    their postings stay put; only the tail, where no term is hot, is shuffled
    (and, for a bucketed target, brought back to its ``buckets`` by document).
    """
    if measured_small(dictionary):
        return postings.join(F.broadcast(dictionary), on)
    if n_postings is None:
        n_postings = dictionary.agg(F.sum("df")).first()[0] or 0
    heavy = dictionary.filter(
        (F.col("df") > n_postings / HEAVY_SLOTS) & (F.octet_length("term") <= HEAVY_TERM_BYTES)
    )
    tail = postings.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(dictionary, on)
    if buckets:
        tail = tail.repartition(buckets, "doc_id")
    return postings.join(F.broadcast(heavy), on).unionByName(tail)
