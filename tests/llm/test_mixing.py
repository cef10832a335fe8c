"""Mixing against plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankspark.llm import mixing as M

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    if n == 1000:
        assert sum(r.p == i for i, r in enumerate(rows)) < 20
        other = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("l")).alias("p")).collect()
        assert sum(a.p == b.p for a, b in zip(rows, other)) < 20


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 5, "é": 7}, {"x": 3}, {"a": 0, "b": 10}, {"a": 10, "b": 500, "c": 500, "d": 2, "e": 9}])
def test_targets_stop_at_three_times_and_share_the_rest(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_mix_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slots, documents = M.mix(docs)
    rows = {r.doc_id: r for r in documents.collect()}
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for d, (text, source) in texts.items():
        assert rows[d].size == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert 0 <= rows[d].taken <= 3 * rows[d].size
        sizes[source] += rows[d].size
        taken[source] += rows[d].taken
    want = brute_targets(sizes)
    for d, (_, source) in texts.items():
        assert rows[d].source_size == sizes[source] and rows[d].target == pytest.approx(want[source])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2 * M.BLOCK_WORDS
    # The blocks of the slots, cut from the laid out documents, hold exactly the words taken.
    uses = Counter((r.source, r.block) for r in slots.collect())
    places = [(r.shard, r.slot) for r in slots.collect()]
    assert len(set(places)) == len(places) and {s * M.SHARD_SLOTS + i for s, i in places} == set(range(len(places)))
    again = defaultdict(int)
    for r in rows.values():
        for word in range(r.start, r.start + r.size):
            again[r.doc_id] += uses[r.source, word // M.BLOCK_WORDS]
    assert all(again[d] == r.taken for d, r in rows.items())
    assert documents.drop("start").exceptAll(M.mix(docs.repartition(7))[1].drop("start")).count() == 0


def test_odd_rows(spark):
    rows = [(1, "a b c " * 100, "x"), (1, "a b c " * 100, "x"), (2, None, "x"), (3, "", None), (None, "q " * 50, None), (4, "w " * 9, ""), (5, None, "none")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("z")).withColumn("row", F.lit(0)).withColumn("chunk", F.lit(0))
    got = M.mix(docs)[1].collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == [(-1, 50), (1, 300), (1, 300), (2, 0), (3, 0), (4, 9), (5, 0)]
    assert all(r.taken <= 3 * r.size for r in got)
    assert {r.source for r in got} == {"x", None, "", "none"}
    slots, documents = M.mix(spark.createDataFrame([], SCHEMA))
    assert slots.collect() == [] and documents.collect() == []
    assert [r.taken for r in M.mix(spark.createDataFrame([(1, None, None)], SCHEMA))[1].collect()] == [0]


def test_small_sources_come_near_their_targets(spark):
    """Twelve sources of 30 words and one of 41: shares of 11 to 57 words, each met to a tenth."""
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(30)), f"s{i:02}") for i in range(12)] + [(99, "x " * 41, "t")]
    documents = M.mix(spark.createDataFrame(rows, SCHEMA))[1].collect()
    for r in documents:
        assert 0 < r.taken <= 3 * r.size and abs(r.taken - r.target) <= 0.1 * r.target, r
    assert sum(r.taken for r in documents) == pytest.approx(401, rel=0.05)


def test_packed_blocks_hold_the_words_of_the_mix(spark):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range((i * 37) % 230)), ["hot", "hot", "a", None][i % 4]) for i in range(60)]
    rows += [(100, "one  two\tthree", "tiny"), (101, None, "a"), (101, "", None), (102, "long " * 30_000, "hot")]
    docs = spark.createDataFrame(rows, SCHEMA)
    _, documents = M.mix(docs)
    words, size = defaultdict(dict), Counter()
    texts = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, _ in rows if t}
    for r in documents.collect():
        for j in range(r.size):
            words[r.source][r.start + j] = texts[r.doc_id][j]
        size[r.source] += r.size
    slots = M.packed_blocks(docs).collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) > 100
    taken = Counter()
    for r in slots:
        length = min(M.BLOCK_WORDS, max(size[r.source] // M.LEAST_BLOCKS, 1))
        low = r.block * length
        assert r.text.split(" ") == [words[r.source][k] for k in range(low, min(low + length, size[r.source]))]
        taken[r.source] += len(r.text.split(" "))
    got = Counter()
    for r in documents.collect():
        got[r.source] += r.taken
    assert got == taken
    assert {(r.shard, r.slot, r.source, r.block, r.text) for r in slots} == {tuple(r) for r in M.packed_blocks(docs).collect()}
