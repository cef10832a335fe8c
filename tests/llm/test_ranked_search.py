"""Ranked lexical search by range maxima, against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from rankspark.llm import interval_search as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """Rows of (item_id, rank, doc_id, score), every document scored."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), n in zip(counts, sizes):
            score = 0
            for w in words(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * n * n_docs // n_words)))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in I.ranked_search(docs, items, **options).collect()), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    common, rare = ["the", "of", "und", "É", "x1"], [f"r{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 12)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(40)]  # more equal scores than ranks
    docs += [(2 * n, "r1 " * 5000), (2 * n + 1, None), (2 * n + 2, "-- !"), (None, "r1 r2 r3"), (5, "r1 The r9")]
    items = [(i, text()) for i in range(30)] + [(50, docs[7][1]), (51, "the " * 50 + "r1 R1 r1"), (52, None), (53, ""), (54, "nowhere"), (50, "r5 r6")]
    return docs, items


@pytest.mark.parametrize("block,group,opened", [(8192, 3_000_000, 4), (50, 3_000_000, 4), (64, 200, 1), (1, 50, 1000)])
def test_equals_scoring_every_document(spark, monkeypatch, block, group, opened):
    monkeypatch.setattr(I, "BLOCK_DOCS", block)
    monkeypatch.setattr(I, "GROUP_POSTINGS", group)
    monkeypatch.setattr(I, "FIRST_OPENED", opened)
    docs, items = corpus(1)
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert len(want) > 500


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(I, "PASS_BYTES", 300)
    docs, items = corpus(2, 150)
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(3, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank int, item_id int")
    wide = spark.createDataFrame([(str(i), t, "x") for i, t in items], "item_id string, text string, doc_id string")
    found = I.ranked_search(frame, wide)
    assert found.schema["item_id"].dataType == T.StringType() and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(((int(a), b, c, d) for a, b, c, d in found.collect()), key=repr) == brute(docs, items)


def test_sparse_tables_give_the_first_of_the_largest():
    rng = np.random.default_rng(5)
    term = np.sort(rng.integers(0, 6, 500))
    doc = np.concatenate([np.sort(rng.choice(400, size=n, replace=False)) for n in np.bincount(term, minlength=6)])
    lists = I.Lists(term, doc, rng.integers(1, 9, 500), 6)
    for t in range(6):
        low, high = lists.start[t], lists.start[t + 1]
        for _ in range(60):
            a, b = sorted(rng.choice(np.arange(low, high + 1), 2, replace=False))
            assert lists.maxima(np.array([a]), np.array([b]))[0] == a + np.argmax(lists.impact[a:b])
            d = rng.integers(0, 401)
            assert lists.first_from(np.array([a]), np.array([b]), np.array([d]))[0] == a + np.searchsorted(lists.doc[a:b], d)


def test_intervals_without_a_chance_stay_closed(monkeypatch):
    """A block whose bounds lie under the k-th score is scored at one document at most."""
    scored = []
    inner = I._bounds
    monkeypatch.setattr(I, "_bounds", lambda lists, count, *rest: scored.append(len(count)) or inner(lists, count, *rest))
    n = 5000
    lists = I.Lists(np.zeros(n, np.int64), np.arange(n), np.full(n, 10), 1)
    best = (np.zeros(20, np.int64), np.arange(220, 200, -1), np.arange(20))
    found = I.search_block(lists, np.arange(n) + 100, np.array([0, 1]), np.array([0]), np.array([5]), best, 20)
    assert [x.tolist() for x in found] == [x.tolist() for x in best] and sum(scored) == 1


def test_a_very_long_text_is_read_whole(spark):
    docs = [(1, "filler " * 300_000 + "needle"), (2, "needle"), (3, "hay")]
    assert run(spark, docs, [(1, "needle")]) == brute(docs, [(1, "needle")])
