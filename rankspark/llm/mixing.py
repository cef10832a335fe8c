"""Mixing sources to target weights by fixed-length token blocks.

Every source's documents are laid end to end and cut into blocks. The output is
a row of slots in shards. Each shard's counts of slots per source are a
multinomial draw given the totals of the whole mix (drawn without replacement
from the sources' slots), so a source meets its target to within a block. The
slots of a source are numbered and mapped to its blocks through one
pseudorandom permutation per pass over the source; blocks join by index. A
source too small for ``LEAST_BLOCKS`` blocks of full length is cut into that
many shorter ones, so that it can be taken in part as well.

Permutations are swap-or-not shuffles: each round reflects an index at a keyed
point and a keyed bit of the pair decides whether to take the partner. That is a
bijection of 0 .. n-1 for any n, in plain column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scale import with_positions
from .common import WORD, partitions, saved, word_count

# ---- fixed values of the mix ------------------------------------------------
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 64
LEAST_BLOCKS = 16
SHARD_SLOTS = 4096
SEED = 20240601
ROUNDS = 32
# -----------------------------------------------------------------------------


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of ``index`` in the keyed permutation of 0 .. n-1; n up to 2 ** 61."""
    points = F.array(*[F.pmod(F.xxhash64(F.lit(SEED), F.lit(r), *key), n) for r in range(ROUNDS)])
    rounds = F.transform(points, lambda p, r: F.struct(p.alias("p"), r.alias("r")))

    def step(x, k):
        partner = F.pmod(k["p"] - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), k["p"], k["r"]).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(rounds, index.cast("long"), step)


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``totals(source, source_size)``.

    Sources by code point, null last, take ``weights`` in turn and share the
    sum of all sizes. A target stops at ``max_repeats`` times its source's size
    and what it leaves is shared anew by weight. The sources whose
    size/weight ratio is least are the ones that stop, so one ordered pass finds
    them: source j stops if, with all before it stopped, its share is too much.
    The table has one row per source and is numbered by range partitions.
    """
    turn = with_positions(totals, [F.col("source").isNull(), F.col("source").cast("binary")], "turn")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    weighed = turn.withColumn("weight", choice).withColumn("limit", F.col("source_size") * max_repeats)
    weighed = weighed.withColumn("ratio", F.col("limit") / F.col("weight"))
    ordered = with_positions(
        weighed, [F.col("ratio"), F.col("turn")], "at", {"limit": "limit_before", "weight": "weight_before"}
    )
    ordered = saved(ordered, "shares")
    total = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weight = float(total[0] or 0), float(total[1] or 1)
    level = (F.lit(size) - F.col("limit_before")) / F.greatest(F.lit(weight) - F.col("weight_before"), F.lit(1e-300))
    # Sources are in the order of their ratios: the first that can take its share ends the stopping.
    first_free = ordered.where(F.col("ratio") >= level).agg(F.min(F.struct("at", level.alias("level")))).first()[0]
    if first_free is None:
        return ordered.select("source", "source_size", F.col("limit").cast("double").alias("target"))
    share = F.col("weight") * F.lit(float(first_free["level"]))
    return ordered.select(
        "source",
        "source_size",
        F.when(F.col("at") < first_free["at"], F.col("limit").cast("double")).otherwise(share).alias("target"),
    )


def _laid_out(sized: DataFrame, *more: str) -> DataFrame:
    """``start``: words of the same source before each document, in an order drawn by hash.

    Sizes are summed over chunks first, so no task orders a whole source: with
    n documents there are sqrt(n) chunks of at most about sqrt(n) documents.
    """
    chunks = math.isqrt(sized.count()) + 1
    rows = sized.withColumn("chunk", F.pmod("draw", F.lit(chunks)))
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("of"),
        F.col("chunk").alias("of_chunk"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "chunk").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk"))
    start = (F.col("before") + F.col("inner")).alias("start")
    return rows.join(sums, same).select("row", "doc_id", "source", "size", start, *more)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = docs[text_col].cast("string")
    rows = docs.select(
        *more,
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(SEED), docs[id_col], text).alias("draw"),
    )
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "sized")


def source_plan(docs_sized: DataFrame, block_words: int, weights, max_repeats) -> DataFrame:
    """Per source: target, blocks, slots and the first of its places among all slots."""
    totals = docs_sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, max_repeats)
    length = F.least(F.lit(block_words), F.greatest(F.floor(F.col("source_size") / LEAST_BLOCKS), F.lit(1))).cast("long")
    plan = plan.withColumn("block_words", length)
    blocks = F.ceil(F.col("source_size") / F.col("block_words")).cast("long")
    # Slots stand for blocks of the average length; a capped source never needs more than its passes.
    share = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size")).cast("long"))
    slots = F.least(share, blocks * max_repeats)
    plan = plan.withColumn("blocks", blocks).withColumn("slots", F.coalesce(F.when(F.col("source_size") > 0, slots), F.lit(0)).cast("long"))
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    return saved(with_positions(plan, order, "source_at", {"slots": "first_place"}), "plan")


def mix_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, slot, source, block)``: which block fills every slot of the output."""
    total = plan.agg(F.sum("slots")).first()[0] or 0
    step = 1 << 12  # places are dealt out in runs, so that a large source is many rows
    runs = plan.where("slots > 0").select(
        "source", "blocks", "slots", "first_place",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long"))).alias("low"),
    ).repartition(partitions(plan.sparkSession), "source", "low")
    places = runs.select(
        "source", "blocks", "first_place",
        F.explode(F.sequence(F.col("low"), F.least(F.col("low") + step, F.col("slots")) - 1)).alias("k"),
    )
    at = permuted(F.col("first_place") + F.col("k"), F.lit(max(total, 1)).cast("long"), F.lit("slots"))
    turn = F.floor(F.col("k") / F.col("blocks")).cast("long")
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("source"), turn)
    return places.select(
        F.floor(at / shard_slots).cast("long").alias("shard"), (at % shard_slots).alias("slot"), "source", block.alias("block")
    )


def _placed(laid: DataFrame, plan: DataFrame) -> DataFrame:
    """Laid out documents with what is known of their sources, and the numbers of the blocks they reach into."""
    # One row per source, joined by size; the larger side may be split at a hot source.
    known = plan.select(F.col("source").alias("of"), "source_size", "target", "block_words")
    rows = laid.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    return rows.withColumns({"first": F.floor(F.col("start") / F.col("block_words")), "last": last})


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(slots, documents)``.

    slots: ``(shard, slot, source, block)``, the output order of the blocks;
    :func:`packed_blocks` gives them with their words.
    documents: every input row as ``(doc_id, source, size, source_size, target,
    taken, start)``; its words are numbers ``start`` to ``start + size - 1`` of
    its source. Block b of a source holds its words ``b * block_words`` onwards;
    a source of fewer than ``LEAST_BLOCKS * block_words`` words has at least
    ``LEAST_BLOCKS`` shorter ones, of one word at least.
    Null texts have size 0; a null source is a source of its own, the last one;
    repeated rows count each; an empty table gives empty results.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = source_plan(sized, block_words, weights, max_repeats)
    slots = mix_slots(plan, shard_slots)
    uses = slots.groupBy(F.col("source").alias("of"), F.col("block").alias("at")).agg(F.count(F.lit(1)).alias("uses"))

    laid = saved(_placed(_laid_out(sized), plan), "laid")
    parts = laid.where("size > 0").select("row", "source", "start", "size", "block_words", F.explode(F.sequence("first", "last")).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    parts = parts.select("row", "source", "block", (high - low).alias("words"))
    met = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    # Both sides grow with the corpus; the planner cannot see that the slots do, so it is told not to broadcast them.
    taken = parts.join(uses.hint("merge"), met).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = laid.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return slots, out.select("doc_id", "source", "size", "source_size", "target", "taken", "start")


def packed_blocks(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(shard, slot, source, block, text)``: the mix itself, every slot with the words of its block, one space between two.

    A block's words come from one or more documents of the source as they are
    laid out; each document is cut once, into the pieces its blocks need, and
    pieces and slots meet by source and block. Odd rows as in :func:`mix`.
    """
    sized = _sized(docs, id_col, text_col, source_col, docs[text_col].cast("string").alias("words"))
    plan = source_plan(sized, block_words, weights, max_repeats)
    rows = _placed(_laid_out(sized, "words"), plan).where("size > 0")

    def piece(words: Column, block: Column) -> Column:
        low = F.greatest(F.col("start"), block * F.col("block_words"))
        high = F.least(F.col("start") + F.col("size"), (block + 1) * F.col("block_words"))
        part = F.slice(words, (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(block.alias("block"), low.alias("low"), F.array_join(part, " ").alias("piece"))

    # The array of words is bound once and cut in place: it is never copied per block.
    words = F.regexp_extract_all("words", F.lit(WORD), F.lit(0))
    pieces = F.transform(F.array(words), lambda w: F.transform(F.sequence("first", "last"), lambda b: piece(w, b)))[0]
    parts = rows.select(F.col("source").alias("of"), F.inline(pieces))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("low", "piece"))), lambda p: p["piece"]), " ")
    blocks = parts.groupBy("of", F.col("block").alias("at")).agg(joined.alias("text"))
    met = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))
    return mix_slots(plan, shard_slots).hint("merge").join(blocks, met).select("shard", "slot", "source", "block", "text")
