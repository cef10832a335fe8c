"""Language-model counts: words that share 32 bits of their hash, and pairs that fill the corpus."""

import resource

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rankspark.llm import lm_scoring as L


def test_words_of_one_32_bit_code_are_told_apart(spark):
    """The two differ in 64 bits but were one word under codes of 32 bits."""
    words = ["w26041", "w95849"]
    codes = [xxhash.xxh64_intdigest(w) % ((1 << 32)) for w in words]
    assert codes[0] == codes[1]
    rows = [(i, f"p {words[0]} x") for i in range(200)] + [(i, f"q {words[1]} y") for i in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [{r.doc_id: r.score for r in L.lm_scores(docs, head_words=n).collect()} for n in (1 << 18, 3, 0)]
    assert got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])


def test_hot_pairs_change_no_score(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "the", "of", f"w{rng.integers(99)}"], size=rng.integers(0, 60), p=[0.4, 0.2, 0.2, 0.1, 0.1])) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = []
    for hot in (L.HOT_PAIRS, 3, 0):
        monkeypatch.setattr(L, "HOT_PAIRS", hot)
        scores.append({r.doc_id: (r.score, r.base_score) for r in L.lm_scores(docs).collect()})
    assert scores[1].keys() == scores[0].keys()
    for other in scores[1:]:
        for doc, values in other.items():
            assert values == pytest.approx(scores[0][doc])


class _Shared:
    def __init__(self, value):
        self.value = value


def _spread_bytes(n_docs, words_each, spark):
    """What leaves the tasks by pair, of documents that are one word over and over."""
    docs = spark.range(n_docs, numPartitions=4).selectExpr("id doc_id", f"repeat('a ', {words_each}) text", "1 role")
    head = L._head(L.count_words(docs), 1 << 18)
    assert len(head["hot"]) > 0
    from pyspark.sql import functions as F

    spread = L._spread(docs.withColumn("row", F.monotonically_increasing_id()), spark.sparkContext.broadcast(head), 4)
    return spread.where("kind = 0").selectExpr("coalesce(sum(octet_length(data)), 0) n").first()[0]


def test_a_hot_pair_needs_the_same_room_however_large_the_corpus(spark):
    """4 and 24 million tokens, nearly all of them one pair: nothing of it goes to the task that counts pairs."""
    small, large = _spread_bytes(40, 100_000, spark), _spread_bytes(240, 100_000, spark)
    assert large <= small + 100_000
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 3 << 20  # kilobytes


def test_counts_are_handed_on_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD_COUNTS", 50)
    docs = spark.createDataFrame([(i, " ".join(f"x{j % 400}" for j in range(i, i + 300)), 1) for i in range(20)], "doc_id long, text string, role int")
    counted = L.count_words(docs).where("h2 is null")
    assert counted.count() == 320 and counted.agg({"c": "sum"}).first()[0] == 20 * 301


def test_equal_keys_are_added_up():
    key = np.array([[2, 0], [1, 0], [2, 0], [1, 5]], np.uint64)
    keys, counts = L._summed([key[:2], key[2:]], [np.array([[1, 0], [2, 1]]), np.array([[3, 1], [4, 0]])])
    assert keys.tolist() == [[1, 0], [1, 5], [2, 0]] and counts.tolist() == [[2, 1], [4, 0], [4, 1]]
    assert pa.array(keys[:, 0].copy().view(np.int64)).to_pylist() == [1, 1, 2]
