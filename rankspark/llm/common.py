"""What several operators share: scratch tables, words, shingles, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import scratch_dir

#: Words are runs of anything but these six characters; bytes.split() cuts at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
XX_SEED = 42
#: Text that a task holds as words at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and reread.

    Lineage ends there: a lost executor costs its running tasks only.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ``""``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def batch_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES):
    """Arrow batches cut to pieces of bounded text (or one text), each with its texts as UTF-8."""
    for batch in batches:
        texts = batch_bytes(batch, column)
        low, size = 0, 0
        for at, text in enumerate(texts):
            if size and size + len(text) > most:
                yield batch.slice(low, at - low), texts[low:at]
                low, size = at, 0
            size += len(text)
        if texts:
            yield batch.slice(low), texts[low:]


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of ``k`` words, repeats included; shorter texts are one shingle, empty ones none."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())]


def hash64(values: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(v, XX_SEED) for v in values), np.uint64, len(values))


def bit_sums(hashes: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each of 64 bits, over how many (or what weight of) hashes it is set."""
    total = np.zeros(64, np.int64 if weights is None else np.float64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for texts of any length
        part = hashes[at : at + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            total += bits.sum(axis=0, dtype=np.int64)
        else:
            total += weights[at : at + (1 << 15)] @ bits
    return total


def simhash(words: list[bytes], k: int) -> int:
    """A bit is 1 if set in over half the shingle hashes; no words give 0. Signed 64 bits."""
    total, n = np.zeros(64, np.int64), 0
    for at in range(0, max(len(words) - k + 1, 1), 1 << 18):
        hashes = hash64(shingles(words[at : at + (1 << 18) + k - 1], k))
        total += bit_sums(hashes)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


def quoted(names: list[str]) -> list[str]:
    """Column names as they are, dots and all."""
    return ["`" + name.replace("`", "``") + "`" for name in names]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` and further columns, given as name and type."""
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    return T.StructType(fields + [T.StructField(name, T._parse_datatype_string(kind), True) for name, kind in more.items()])


def map_batches(df: DataFrame, schema: str | T.StructType, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    names = df.columns
    if not any(set(".`") & set(name) for name in names):
        return df.mapInArrow(function, schema)

    # mapInArrow takes no names with dots: columns travel under their numbers.
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(pa.RecordBatch.from_arrays(batch.columns, names) for batch in batches)

    return df.toDF(*map(str, range(len(names)))).mapInArrow(named, schema)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a long, b long)``; root: the least node of the component.

    Alternates two linear steps (link larger neighbours to the least one, then
    smaller ones) until nothing changes. Each round is aggregates with partial
    sums and joins that Spark can split at a hub, and ends in a written table.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = saved(small.union(least).distinct(), "small")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return roots.union(own.join(roots.select("node"), "node", "left_anti"))
