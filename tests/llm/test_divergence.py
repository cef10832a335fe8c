"""Source divergence over a pattern tree, against every pair and word counted out."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankspark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_docs=10):
    docs = [tuple(v or "" for v in row) for row in docs]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        found = TERM.findall(text.translate(LOWER))
        df[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = {}
        whole = Counter()
        for source in sources:
            own = {t: counts[lang, source][t] for t in kept}
            whole.update(own)
            share[source] = {t: 1 + 10**9 * (own[t] + 2) // (sum(own.values()) + 2 * len(kept)) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        for source in sources:
            p = share[source]
            pairs = [(sum(f(p[t], share[o][t]) for t in kept), o) for o in sources if o != source]
            words = [(f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
            for part, rows in (("pair", pairs), ("term", words)):
                ranked = sorted(rows, key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, source, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= 10]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "OF", "É", "ß", "und", "don't", "a1b"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(6)]
    docs = []
    for _ in range(n):
        source = rng.choice(["hot"] * 5 + ["s1", "s2", "s3", "Z", "é", None])
        docs.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(words, k=rng.randint(0, 40)))))
    docs += [("fr", "only", "too few words"), ("xx", "a", ""), ("xx", "b", None), ("en", "bare", "12 34"), ("de", "long", "the " * 40_000)]
    return docs


def run(spark, docs, **options):
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    return sorted(tuple(r) for r in D.divergence(frame, **options).collect())


@pytest.mark.parametrize("held,cells,block", [(600_000, 20_000_000, 1_000_000), (20, 10, 3)])
def test_equals_counting_everything_out(spark, monkeypatch, held, cells, block):
    monkeypatch.setattr(D, "HELD_WORDS", held)
    monkeypatch.setattr(D, "HELD_CELLS", cells)
    monkeypatch.setattr(D, "BLOCK_CELLS", block)
    docs = corpus(1)
    want = brute(docs)
    assert run(spark, docs) == want
    assert ("xx", "a", "pair", "b", 0, 1) in want and ("fr", "only") not in {r[:2] for r in want}


def test_languages_in_turn(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_GROUPS", 3)
    docs = corpus(2, 150)
    assert run(spark, docs) == brute(docs)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    docs = corpus(3, 60)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, source string, text string, item int, rank string")
    assert sorted(tuple(r) for r in D.divergence(frame, min_docs=3).collect()) == brute(docs, 3)


def test_shares_stay_exact_beyond_64_bits(spark):
    count, total, kept = 10**12 + 7, 3 * 10**13 + 1, 12345
    row = spark.range(1).selectExpr(f"{count} c", f"{total} n", f"{kept} k").select(D.share(*(D.F.col(c) for c in "cnk")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_shared_paths_are_closed_once():
    """Three words, two of them alike, and a fourth with their beginning: one node each, with multiplicities."""
    rest = np.array([5, 7, 9, 11])
    a, b = np.array([0, 1, 2]), np.array([0, 3])
    rows = [("x", a, np.array([1, 2, 3]), np.array([50, 60, 70]), 2), ("x", b, np.array([1, 4]), np.array([50, 90]), 3)]
    closed = []
    inner = D.PairSums.close
    D.PairSums.close = lambda self, s, p, depth, times: closed.append((s[depth:].tolist(), times.tolist())) or inner(self, s, p, depth, times)
    try:
        got = defaultdict(int)
        for _, x, y, part in D.walk(rows, {"x": rest}):
            for i, j, v in zip(x.tolist(), y.tolist(), part.tolist()):
                got[i, j] += v
    finally:
        D.PairSums.close = inner
    assert closed == [([1, 2], [2, 2]), ([0, 3], [5, 3])]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for i in range(4):
        for j in range(i + 1, 4):
            want = 0
            for _, s, _, p, n in rows:
                full = dict(zip(s.tolist(), p.tolist()))
                want += n * (f(full.get(i, rest[i]), full.get(j, rest[j])) - f(rest[i], rest[j]))
            assert got[i, j] == want
