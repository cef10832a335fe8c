"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits, and every non-zero
vector ``v`` a mask: the positions whose own vector has even overlap with it are
left out. For a pair that differs in at most ``radius`` positions, that many
linear equations in ``radius + 1`` unknowns leave a non-zero ``v`` whose mask
misses all these positions: the pair agrees on the masked bits, for certain.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import HEAVY_SLOTS, broadcast_if_small
from .common import batch_bytes, components, fresh, map_batches, saved, simhash

#: Buckets of more distinct fingerprints are linked through shared neighbours instead of pairs.
PAIRED_BUCKET = 32
#: Components of more rows than this, and of more than 1/HEAVY_SLOTS of all, are not shuffled.
HEAVY_ROWS = 1_000


def masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks of 64 bits, each leaving out three sevenths (radius 2)."""
    vectors = range(1, 1 << (radius + 1))
    own = [1 + (i * 5 + i // 7) % len(vectors) for i in range(64)]
    return [sum(((v & own[i]).bit_count() & 1) << i for i in range(64)) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp long)`` for every row; null and wordless texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            prints = [simhash(b.lower().split(), shingle_words) for b in batch_bytes(batch, "text")]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(rows, "doc_id long, text_hash long, fp long", run)


def near_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints of ``prints(fp)`` (distinct) within ``radius``.

    Small buckets give their pairs. In a bucket of more than ``PAIRED_BUCKET``
    members, each is linked to the least member that shares one of its
    neighbours at ``radius / 2`` bits: two fingerprints have such a neighbour in
    common if and only if they lie within ``radius``, so no link is lost, and
    the work stays in proportion to the members.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    table_masks = masks(radius)
    fp = F.col("fp")
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(table_masks)])).alias("k"),
    ).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(keyed.join(sizes, ["t", "key"]), "members")

    left = members.where(F.col("n") <= PAIRED_BUCKET).select("t", "key", F.col("fp").alias("a"))
    right = left.withColumnRenamed("a", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["t", "key"]).where((F.col("a") > F.col("b")) & near).select("a", "b")

    free = [[i for i in range(64) if not m >> i & 1] for m in table_masks]
    flips = [
        [_signed(sum(1 << i for i in c)) for n in range(radius // 2 + 1) for c in combinations(bits, n)] for bits in free
    ]
    of_table = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in f]) for f in flips]), F.col("t") + 1)
    stars = (
        members.where(F.col("n") > PAIRED_BUCKET)
        .select("fp", F.explode(of_table).alias("flip"))
        .select("fp", fp.bitwiseXOR(F.col("flip")).alias("star"))
    )
    # A star is a point of the Hamming cube: its group is bounded by the number of flips.
    linked = stars.groupBy("star").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    linked = linked.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.union(linked).distinct()


def with_root(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with an aggregate over all rows of their ``root``; ``rows`` should be a written table.

    Aggregates are pre-aggregated by Spark. Roots of many rows, at most
    ``HEAVY_SLOTS`` of them, are broadcast, so that their rows stay where they
    are; only rows of small components are shuffled.
    """
    counted = saved(rows.groupBy("root").agg(value, F.count(F.lit(1)).alias("_rows")), "roots")
    total = counted.agg(F.sum("_rows")).first()[0] or 0
    is_heavy = F.col("_rows") > max(HEAVY_ROWS, total // HEAVY_SLOTS)
    heavy, light = F.broadcast(counted.where(is_heavy).drop("_rows")), counted.where(~is_heavy).drop("_rows")
    few = rows.join(heavy.select("root"), "root", "left_anti").join(light, "root")
    return rows.join(heavy, "root").unionByName(few)


def link(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints(doc_id, text_hash, fp)`` plus the component's root and component_id, the least doc_id reachable over links.

    Links are found between distinct fingerprints, so copies cost one row each.
    Repeated rows stay; an empty table gives an empty one; a null doc_id keeps
    its row and never becomes a component's id unless all are null.
    """
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_pairs(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted, "rooted")
    known = with_root(rooted, F.min("first").alias("component_id")).select("fp", "root", "component_id")
    return prints.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def simhash_components(
    docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Words are lower-cased in A-Z only. Null, empty and wordless texts share
    fingerprint zero and are linked like any other.
    """
    prints = saved(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    linked = link(prints, radius)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, shingle_words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs``, whole, for each component: the one of least id.

    Rows without id come last; of equal rows (id and text) one stays. What goes is found on ids and hashes alone and
    taken out by an anti-join, so texts are shuffled only where the list of what
    goes is too large to broadcast.
    """
    prints = saved(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    linked = link(prints, radius)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    texts = saved(linked.groupBy("root", row.alias("row")).agg(F.count(F.lit(1)).alias("rows")), "texts")
    goes = with_root(texts, F.min("row").alias("first")).where(F.col("row") != F.col("first")).select("row.*")
    texts = texts.select("row.*", "rows")
    own_hash, gone_id, gone_hash = (fresh(docs, name) for name in ("_simhash_text", "gone_id", "gone_hash"))
    hashed = docs.withColumn(own_hash, F.xxhash64(docs[text_col].cast("string")))
    of, there = F.col(gone_id), F.col(gone_hash)
    gone = broadcast_if_small(goes.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)))
    kept = hashed.join(gone, hashed[id_col].cast("long").eqNullSafe(of) & (hashed[own_hash] == there), "left_anti")
    again = texts.where("rows > 1").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    again = broadcast_if_small(saved(again.distinct(), "again"))
    same = kept[id_col].cast("long").eqNullSafe(of) & (kept[own_hash] == there)
    once = kept.join(again, same, "left_semi").dropDuplicates([id_col, own_hash])
    return kept.join(again, same, "left_anti").union(once).drop(own_hash)
