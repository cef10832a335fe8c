"""SimHash near-duplicates against brute force."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from rankspark.llm import simhash_dedup as S
from rankspark.llm.common import components, simhash

SCHEMA = "doc_id long, text string"


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """{doc: least doc reachable} by comparing all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_every_pair_within_the_radius_meets_under_some_mask(radius):
    masks = S.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), min(radius, 2)):
        assert any(all(not m >> b & 1 for b in bits) for m in masks)
    rng = random.Random(1)
    for _ in range(2000):
        bits = rng.sample(range(64), radius)
        assert any(all(not m >> b & 1 for b in bits) for m in masks)


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: brute_print(t) for d, t in rows.items()}
    got = {r.doc_id: r for r in S.simhash_components(docs).collect()}
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints, 2)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(prints, 2).values()))


def test_large_buckets_lose_no_link(spark):
    """Hundreds of prints a few bits from one: pairs are not all emitted, links are complete."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(400):
        x = base
        for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    named = dict(enumerate(sorted(prints)))
    signed = [(d, x - (1 << 64) if x >> 63 else x) for d, x in named.items()]
    frame = spark.createDataFrame(signed, "doc_id long, fp long").withColumn("text_hash", F.lit(0).cast("long"))
    edges = S.near_pairs(frame.select("fp"), 2)
    assert edges.count() < 40 * len(prints)
    got = {r.doc_id: r.component_id for r in S.link(frame, 2).collect()}
    assert got == brute_components(named, 2)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(3, None), (1, ""), (2, " \n\t"), (7, "One Two"), (8, "one two"), (8, "one two"), (9, long), (10, long + " x"), (None, "one two"), (11, "é ñ")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {g[0]: g for g in got}
    assert {by_id[d][1:] for d in (1, 2, 3)} == {("0" * 16, 1)}
    assert {by_id[d][2] for d in (7, 8, None)} == {7}
    assert int(by_id[9][1], 16) == simhash(long.encode().split(), 3) % 2**64 == brute_print(long)
    assert by_id[10][2] == 9
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 9, 11]
    only_null = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "d e f g"), (5, "d e f g")], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(only_null).collect()), key=repr) == [(5, "d e f g"), (None, "a b c")]
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_components(empty).collect() == [] and S.drop_near_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        S.near_pairs(empty.selectExpr("doc_id fp"), 3)


@pytest.mark.parametrize("heavy", [0, 3, 1_000])
def test_rows_get_what_their_root_has_without_a_shuffle_of_hot_roots(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "HEAVY_ROWS", heavy)
    rows = [(7, i) for i in range(50)] + [(r, 100 + r) for r in range(20, 30)] + [(40, 5), (40, 5), (None, 1)]
    frame = spark.createDataFrame(rows, "root long, x long").repartition(5)
    got = sorted((r.root, r.x, r.least) for r in S.with_root(frame.where("root is not null"), F.min("x").alias("least")).collect())
    least = {}
    for root, x in rows:
        least[root] = min(x, least.get(root, x))
    assert got == sorted((root, x, least[root]) for root, x in rows if root is not None)


def test_one_component_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY_ROWS", 5)
    same = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(i, same) for i in range(60)] + [(100 + i, f"{i} other words {i * 7} of all {i * 13} kinds {i * 29} here {i * 31}") for i in range(20)]
    kept = S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    linked = {r.doc_id: r.component_id for r in S.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(set(linked.values()))
    assert all(linked[i] == 0 for i in range(60))
