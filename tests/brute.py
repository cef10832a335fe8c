"""Straightforward BM25 in plain Python, to compare against."""

import math
import re
from collections import Counter


def quantize(n):
    """The length code by bit shifting, step by step."""
    if n < 40:
        return n
    n -= 24
    shift = n.bit_length() - 4
    return 24 + ((n >> shift) << shift)


class Brute:
    def __init__(self, texts, k1=1.2, b=0.75, quantized=True, use_norms=True):
        self.docs = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in texts.items()}
        self.len = {i: sum(c.values()) for i, c in self.docs.items()}
        self.n = sum(1 for x in self.len.values() if x)
        self.avgdl = sum(self.len.values()) / self.n
        self.df = Counter(t for c in self.docs.values() for t in c)
        self.k1, self.b, self.quantized, self.use_norms = k1, b, quantized, use_norms

    def partial(self, doc, term):
        tf, df = self.docs[doc][term], self.df[term]
        if not tf:
            return 0.0
        idf = math.log(1 + (self.n - df + 0.5) / (df + 0.5))
        length = quantize(self.len[doc]) if self.quantized else self.len[doc]
        length = length if self.use_norms else 1
        norm = self.k1 * ((1 - self.b) + self.b * length / self.avgdl)
        return idf * (self.k1 + 1) * tf / (tf + norm)

    def scores(self, terms, accept=None):
        out = {}
        for doc, counts in self.docs.items():
            if any(counts[t] for t in terms) and (accept is None or doc in accept):
                out[doc] = sum(self.partial(doc, t) for t in terms)
        return out

    def top(self, terms, k, accept=None):
        ranked = sorted(self.scores(terms, accept).items(), key=lambda x: (-math.floor(x[1] * 1e6 + 0.5), x[0]))
        return ranked if k < 0 else ranked[:k]


def brute_of(corpus, **options):
    return Brute({r["doc_id"]: r["text"] for r in corpus.collect()}, **options)


def hits(df, query_id=0):
    rows = sorted((r for r in df.collect() if r["query_id"] == query_id), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["doc_id"], r["score"]) for r in rows]


def same(actual, expected):
    assert [d for d, _ in actual] == [d for d, _ in expected]
    for (_, a), (_, b) in zip(actual, expected):
        assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
