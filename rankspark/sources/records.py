"""Records of delimited files in which a quoted field may hold newlines, read by many tasks.

A line by itself does not tell whether it begins inside quotes. A first reading
reports for every split how many quotes it holds (odd or even) and how many
lines begin records in either case. A running sum over the splits says in which
state each begins, and from there every task knows its lines' states and record
numbers by itself. Only lines of records that span several lines are exchanged,
by record; all others stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scale import MOVED, _in_files, count_before, cut_lineage, measured_small, small_or_raise, task_of, with_positions

KEY = ["_file", "_block"]


def _plain(value: Column, escape: str) -> Column:
    """``value`` without escaped quotes that are not two quotes."""
    return value if escape == '"' else F.regexp_replace(value, r'\\["\\]', "")


def _quotes(value: Column, escape: str) -> Column:
    """How many quotes open or close something."""
    plain = _plain(value, escape)
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit('"'), F.lit("")))


def _outside(value: Column, escape: str) -> Column:
    """``value`` without what stands in quotes; from a last quote that stays open all is cut off."""
    return F.regexp_replace(_plain(value, escape), r'"[^"]*(?:"|\z)', "")


def _read_lines(spark: SparkSession, files: list[str], escape: str) -> DataFrame:
    """``(value, _file, _block, _line, _odd, _quotes)``: lines with the quotes before them in their task, odd or even."""
    lines = spark.read.option("lineSep", "\n").text(files)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumns({"_odd": _quotes(F.col("value"), escape) % 2 == 1, "_line": F.monotonically_increasing_id()})
    return count_before(lines, F.col("_odd"), "_quotes")


def _split_states(lines: DataFrame) -> DataFrame:
    """One row per split: whether it begins inside quotes, and how many records begin in it and before it in its file."""
    even = F.col("_quotes") % 2 == 0
    seen = lines.groupBy(*KEY).agg(
        F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min("_quotes").alias("_quotes0"),
        F.count_if("_odd").alias("_odds"), F.count_if(even).alias("_evens"),
    )
    seen = cut_lineage(seen)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_state", F.coalesce(F.sum("_odds").over(earlier), F.lit(0)) % 2)
    outside = (F.col("_quotes0") + F.col("_state")) % 2 == 0
    seen = seen.withColumn("_begun", F.when(outside, F.col("_evens")).otherwise(F.col("_n") - F.col("_evens")))
    return seen.withColumn("_records0", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)))


def _in_task(splits: DataFrame, column: str) -> Column:
    """The sum of ``column`` over the splits that the same task reads earlier."""
    earlier = Window.partitionBy(task_of("_first")).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _with_records(lines: DataFrame, splits: DataFrame, whole: bool) -> DataFrame:
    """Lines with ``_inside`` (begins in quotes), ``_spans`` (of a record of several lines) and ``_record``, numbered per file.

    ``splits`` may be some of them, unless ``whole``: then a line without its split is an error.
    """
    offsets = splits.withColumn("_begun0", _in_task(splits, "_begun"))
    rows = lines.join(small_or_raise(offsets, "splits of the input"), KEY, "left" if whole else "inner")
    at = F.col("_line") - F.col("_first")
    sound = (at >= 0) & (at < F.col("_n"))
    inside = F.when(sound, F.pmod(F.col("_quotes") - F.col("_quotes0") + F.col("_state"), F.lit(2)) == 1)
    rows = rows.withColumn("_inside", inside.otherwise(F.raise_error(F.lit(MOVED)).cast("boolean")))
    rows = count_before(rows, ~F.col("_inside"), "_before")
    record = F.col("_records0") + F.col("_before") - F.col("_begun0") - F.col("_inside").cast("int")
    return rows.withColumns({"_record": record, "_spans": F.col("_inside") | F.col("_odd")})


def _joined(rows: DataFrame, *more: Column) -> DataFrame:
    """Records that span lines, put together."""
    parts = F.sort_array(F.collect_list(F.struct("_block", "_line", "value")))
    return rows.groupBy("_file", "_record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), *more)


def _ended(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\z", "")


def _wide(value: Column, escape: str, columns: int) -> Column:
    """Whether a record has so many columns; blank records have none."""
    commas = F.regexp_count(_outside(value, escape), F.lit(","))
    return (commas >= columns - 1) & (F.trim(value) != "")


def read_records(spark: SparkSession, files: list[str], columns: int, escape: str = '"') -> DataFrame:
    """``(value, _file, _record)``: all records of at least so many columns but the first of each file."""
    lines = _read_lines(spark, files, escape)
    splits = _split_states(lines)
    rows = _with_records(lines, splits, True)
    if splits.agg(F.sum("_odds")).first()[0]:
        single = rows.where(~F.col("_spans")).select("value", "_file", "_record")
        rows = single.unionByName(_joined(rows.where("_spans")))
    records = rows.select(_ended(F.col("value")).alias("value"), "_file", "_record")
    return records.where((F.col("_record") > 0) & _wide(F.col("value"), escape, columns))


def _short_records(lines: DataFrame, splits: DataFrame, columns: int, escape: str) -> DataFrame:
    """``(_file, _record, _block)`` of the records that do not count: too few columns, blank, or the first of a file.

    Only numbers are exchanged, and only those of lines that do not decide it by themselves.
    """
    rows = _with_records(lines, splits, True)
    value = F.col("value")
    opened = F.when(F.col("_inside"), F.concat(F.lit('"'), value)).otherwise(value)
    commas = F.regexp_count(_outside(opened, escape), F.lit(","))
    blank = ~F.col("_spans") & (F.trim(value) == "")
    rows = rows.withColumn("_commas", F.when(blank, -1).otherwise(commas))
    open_ = rows.where(F.col("_spans") | (F.col("_commas") < columns - 1) | (F.col("_record") == 0))
    sums = open_.groupBy("_file", "_record").agg(F.sum("_commas").alias("_commas"), F.min("_block").alias("_block"))
    short = sums.where((F.col("_commas") < columns - 1) | (F.col("_record") == 0))
    return cut_lineage(short.select("_file", "_record", "_block"))


def _needed(splits: DataFrame, limit: int) -> DataFrame:
    """Splits in which one of the first records begins or goes on."""
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("_begun") > 0, F.col("_base")), ignorenulls=True).over(earlier)
    goes_on = F.coalesce((F.col("_state") == 1) & (begun < limit), F.lit(False))
    return cut_lineage(splits.withColumn("_goes_on", goes_on).where((F.col("_base") < limit) | F.col("_goes_on")).drop("_goes_on"))


def read_numbered_records(spark: SparkSession, files: list[str], columns: int, escape: str = '"', limit: int | None = None) -> DataFrame:
    """``(doc_id, value)``: the same records numbered 0, 1, 2, … by file and place.

    Two readings count, a third one numbers. Texts are neither sorted nor stored;
    of the lines only those of records that span several are exchanged. With a
    ``limit``, files are counted in growing groups until they hold so many, and
    splits behind the last one needed are left out.
    """
    files = sorted(files)
    taken = len(files) if limit is None else min(1, len(files))
    while True:
        lines = _read_lines(spark, files[:taken], escape)
        splits = _split_states(lines)
        short = _short_records(lines, splits, columns, escape)
        if not measured_small(short):
            records = read_records(spark, files, columns, escape)
            numbered = with_positions(records, [F.col("_file"), F.col("_record")], "doc_id").select("doc_id", "value")
            return numbered if limit is None else numbered.where(F.col("doc_id") < limit)
        dropped = short.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_short"))
        splits = splits.join(dropped, KEY, "left").withColumn("_kept", F.col("_begun") - F.coalesce("_short", F.lit(0)))
        earlier = Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
        splits = cut_lineage(splits.withColumn("_base", F.coalesce(F.sum("_kept").over(earlier), F.lit(0))))
        if limit is None or taken == len(files) or (splits.agg(F.sum("_kept")).first()[0] or 0) >= limit:
            break
        taken = min(2 * taken, len(files))

    if limit is not None:
        splits = _needed(splits, limit)
        lines = lines.where(_in_files(splits))
    rows = _with_records(lines, splits.withColumn("_kept0", _in_task(splits, "_kept")), limit is None)
    rows = rows.join(F.broadcast(short.select("_file", "_record", F.lit(True).alias("_is_short"))), ["_file", "_record"], "left")
    kept = F.col("_is_short").isNull()
    rows = count_before(rows, kept & ~F.col("_inside"), "_kept_before")
    doc_id = F.col("_base") + F.col("_kept_before") - F.col("_kept0")
    rows = rows.withColumn("doc_id", F.when(~F.col("_inside"), doc_id)).where(kept)
    single = rows.where(~F.col("_spans")).select("doc_id", "value")
    if splits.agg(F.sum("_odds")).first()[0]:
        spanning = _joined(rows.where("_spans"), F.max("doc_id").alias("doc_id")).where("doc_id is not null")
        single = single.unionByName(spanning.select("doc_id", "value"))
    out = single.select("doc_id", _ended(F.col("value")).alias("value"))
    return out if limit is None else out.where(F.col("doc_id") < limit)
