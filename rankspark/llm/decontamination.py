"""Benchmark decontamination with SimHash windows and exact verification.

A document is searched with windows as long as each benchmark item. A window's
SimHash is looked up among the items of its length through a multi-index: the
fingerprint is cut into blocks, and of two fingerprints within the radius some
block differs in at most ``radius // blocks`` bits, so probing every block with
all such changes finds every item within the radius. Items found are verified
by the exact weighted similarity of their shingles.

The similarity of a window to an item of its length is bounded by how many of
its shingles occur in any item of that length, in whatever order. These are
counted over a sliding window, and every window is hashed whose count can still
reach the least similarity; the others cannot be hits.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, bit_sums, fresh, hash64, map_batches, shingles, with_fields

# ---- parameters --------------------------------------------------------------
SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
#: Benchmark text that one pass over the documents holds in memory; more items take more passes.
PASS_BYTES = 32 * 1024 * 1024
SCAN_WORDS = 1 << 18
# ------------------------------------------------------------------------------

HIT = "struct<item_id:bigint,start_word:bigint,n_words:int,distance:int,similarity:double>"


def fingerprint(hashes: np.ndarray) -> int:
    return int(np.packbits(2 * bit_sums(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard; a shingle weighs as often as it occurs."""
    both = sum(min(n, b[s]) for s, n in a.items())
    return both / (a.total() + b.total() - both) if both else 0.0


class Items:
    """The items of one pass: shingle places and one multi-index per item length."""

    def __init__(self, items: list[tuple[int | None, bytes]], radius: int = RADIUS, blocks: int = BLOCKS):
        width = 64 // blocks
        self.radius, self.blocks, self.width = radius, blocks, width
        self.changes = [
            sum(1 << i for i in c) for n in range(radius // blocks + 1) for c in combinations(range(width), n)
        ]
        self.items, self.lengths = [], defaultdict(set)
        self.index: dict[int, list[dict[int, list[int]]]] = {}
        for item_id, text in items:
            words = text.lower().split()
            if len(words) < SHINGLE_WORDS:
                continue
            own, found = len(self.items), shingles(words, SHINGLE_WORDS)
            print_ = fingerprint(hash64(found))
            self.items.append((item_id, len(words), print_, Counter(found)))
            for s in found:
                self.lengths[s].add(len(words))
            tables = self.index.setdefault(len(words), [defaultdict(list) for _ in range(blocks)])
            for b, table in enumerate(tables):
                table[print_ >> b * width & (1 << width) - 1].append(own)
        self.lengths = {s: tuple(own) for s, own in self.lengths.items()}

    def within(self, length: int, print_: int) -> list[tuple[int, int]]:
        """All items of ``length`` words whose fingerprint is within the radius, with their distance."""
        found = set()
        for b, table in enumerate(self.index[length]):
            block = print_ >> b * self.width & (1 << self.width) - 1
            for change in self.changes:
                found.update(table.get(block ^ change, ()))
        near = ((i, (self.items[i][2] ^ print_).bit_count()) for i in found)
        return [(i, d) for i, d in near if d <= self.radius]

    def windows(self, words: list[bytes]) -> dict[int, list[int]]:
        """Starts of windows worth hashing, by length: those with shared shingles enough for the least similarity."""
        shared = defaultdict(list)
        for low in range(0, len(words), SCAN_WORDS):
            part = words[low : low + SCAN_WORDS + SHINGLE_WORDS - 1]
            for at, s in enumerate(shingles(part, SHINGLE_WORDS)) if len(part) >= SHINGLE_WORDS else ():
                for length in self.lengths.get(s, ()):
                    shared[length].append(low + at)
        out = {}
        for length, places in shared.items():
            n = min(length, len(words)) - SHINGLE_WORDS + 1  # shingles of a window
            # both / (item + window - both) >= least similarity
            need = MIN_SIMILARITY * (length - SHINGLE_WORDS + 1 + n) / (1 + MIN_SIMILARITY) - 1e-6
            if len(places) < need:
                continue
            before = np.zeros(len(words) - SHINGLE_WORDS + 2, np.int64)
            before[np.array(places) + 1] = 1
            before = np.cumsum(before)
            out[length] = np.nonzero(before[n:] - before[:-n] >= need)[0].tolist()
        return out

    def hits(self, text: bytes) -> list[dict]:
        """The best window of every item found in the text, by similarity, then by its start."""
        words = text.lower().split()
        best: dict[int, tuple] = {}
        for length, starts in self.windows(words).items():
            for start in starts:
                own = shingles(words[start : start + length], SHINGLE_WORDS)
                counted = None
                for i, distance in self.within(length, fingerprint(hash64(own))):
                    counted = counted or Counter(own)
                    same = similarity(counted, self.items[i][3])
                    if same >= MIN_SIMILARITY and (i not in best or (same, -start) > best[i][:2]):
                        best[i] = (same, -start, distance, min(length, len(words)))
        return [
            {"item_id": self.items[i][0], "start_word": -b[1], "n_words": b[3], "distance": b[2], "similarity": b[0]}
            for i, b in sorted(best.items())
        ]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    hits_col: str = "hits",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """All columns of ``docs`` plus the array of benchmark items found in each text.

    Null texts have no hits; items that are null or of fewer words than a
    shingle match nothing; repeated items are reported each; repeated documents
    stay. A column of ``docs`` named like the new one is replaced. A benchmark
    larger than ``pass_bytes`` is searched in several passes, so what is sent to
    the executors at once stays bounded.
    """
    docs = docs.drop(hits_col)
    items = benchmark.select(
        benchmark[item_id_col].cast("long").alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = max(1, math.ceil(2 * size / pass_bytes)) if size > pass_bytes else 1
    context = docs.sparkSession.sparkContext
    found = []
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        sent = context.broadcast(sorted(((r["item_id"], r["text"].encode()) for r in own.collect()), key=repr))
        name = fresh(docs, f"{hits_col}_{k}") if passes > 1 else hits_col

        def run(batches, sent=sent, name=name):
            index = Items(sent.value)
            for batch in batches:
                hits = [index.hits(b) for b in batch_bytes(batch, text_col)]
                kind = pa.list_(
                    pa.struct(
                        [("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())]
                    )
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], [*batch.schema.names, name])

        docs = map_batches(docs, with_fields(docs, **{name: f"array<{HIT}>"}), run)
        found.append(name)
    if passes > 1:
        docs = docs.withColumn(hits_col, F.concat(*found)).drop(*found)
    return docs


def decontamination_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, distance, similarity)``: every benchmark item found in a document."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return contaminated(rows, benchmark).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
