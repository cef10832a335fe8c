"""URL rules against plain Python, and the trees by held-out accuracy."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankspark.llm import url_filter as U

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, rest = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    ends = [i for i, c in enumerate(rest) if c in "?#"]
    return host.translate(LOWER), rest[: min(ends, default=len(rest))]


def rule_of(host, path):
    best = None
    for rule, verdict in U.RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "https://net", "https://net/", "http://NET/x", "http://a.net/en/1", "http://example.net/en/", "http://x.Example.NET/en/1?q=/de/",
    "http://badexample.net/en/1", "http://example.net/EN/1", "http://example.net/en", "ftp://w.example.com/de/4#a", "http://example.com/den/", "http://org/fr/",
    "http://a.b.org/fr/x", "http://xorg/fr/x", "http://net:80/x", "http://u@net/x", "http://x.net?/en/", "a://b://c.net/d", "http://é.ÉXAMPLE.org/fr/é", "x" * 50_000,
    "http://a.example.com/en/" + "y" * 100_000, "http:// a.net/x y\nz",
]


def test_rules_equal_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS + URLS[:6])], "page_id long, url string, host string")
    rows = U.url_filter(pages).collect()
    assert rows[0].asDict().keys() == {"page_id", "url", "host", "host_", "path", "rule", "verdict", "score"}
    assert len(rows) == len(URLS) + 6
    for r in rows:
        host, path = split(r.url)
        rule, verdict = rule_of(host, path)
        assert (r.host, r.host_, r.path, r.rule) == ("own", host, path, rule), r.url
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)


def labelled(n, seed):
    """URLs of two kinds that differ in digits, depth, parameters and suffix, with some noise."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        if bad:
            url = f"http://{word(4)}-{word(4)}-{rng.randint(100, 9999)}.{rng.choice(['biz', 'info', 'com'])}/{rng.randint(1, 10**6)}/{word(3)}.php?a={rng.randint(1, 99)}&b={word(2)}&c=1"
        else:
            url = f"https://www.{word(7)}.{rng.choice(['org', 'edu', 'com'])}/{word(6)}/{word(5)}/{word(8)}.html"
        rows.append((i, url, bad if rng.random() > 0.03 else not bad))
    return rows


def test_trees_learn_from_labelled_urls(spark):
    rows = spark.createDataFrame(labelled(1200, 1), "page_id long, url string, blocked boolean")
    held = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(4)) == 2
    judged = U.url_filter(rows.where(held), rules=(), labels=rows.where(~held)).collect()
    right = sum((r.verdict == "block") == r.blocked for r in judged)
    assert right / len(judged) > 0.9 and len(judged) > 200
    assert all(0 <= r.score <= 1 and r.rule is None for r in judged)
    again = U.url_filter(rows.where(held), rules=(), labels=rows.where(~held)).collect()
    assert {r.page_id: r.verdict for r in again} == {r.page_id: r.verdict for r in judged}


def test_held_out_rules(spark, sf_dir):
    """URLs whose rule is kept from the trees are mostly judged as the rule would."""
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url")
    rows = [(r.page_id, r.url, rule_of(*split(r.url))[1]) for r in pages.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = spark.createDataFrame([(u, v == "block") for i, u, v in rows if v and not held(i)], "url string, blocked boolean")
    asked = {i: (u, v) for i, u, v in rows if v and held(i)}
    judged = U.url_filter(spark.createDataFrame([(i, u) for i, (u, _) in asked.items()], "page_id long, url string"), rules=(), labels=known).collect()
    assert sum(r.verdict == asked[r.page_id][1] for r in judged) / len(asked) > 0.9


def test_features_and_their_statistics(spark):
    url = "http://a-b.Example.com/one/two3.html?x=1&y=2;z#f&g"
    row = spark.createDataFrame([(url,)], "u string").select(*U.lexical_features(F.col("u"), U.host_of(F.col("u")), U.path_of(F.col("u")))).first()
    counts = {c: url.count(c) for c in set(url)}
    entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in counts.values())
    assert row.entropy == pytest.approx(entropy) and row.digit_ratio == pytest.approx(3 / len(url))
    assert (row.depth, row.host_labels, row.hyphens, row.parameters, row.path_length) == (2, 3, 1, 3, 14)
    # A row's own label is left out of its suffixes' rates.
    parts = [("http://a.x/p/", 1.0), ("http://b.x/p/", 0.0), ("http://c.y/p/", 1.0)]
    rows = U._prepared(spark.createDataFrame([(0, u, y) for u, y in parts], "_at int, _url string, _label double"))
    rated = U._with_rates(rows, U._suffix_counts(rows), 0.5, F.col("_label")).collect()
    got = sorted(round(r.top_label_rate, 6) for r in rated)
    assert got == sorted(round(v, 6) for v in [(0 + 5) / 11, (1 + 5) / 11, 5 / 10])


@pytest.mark.parametrize("urls,verdicts", [([], set()), (["http://a.com/x"], {"allow"}), (["http://a.net/x", "http://a.com/x"], {"block"})])
def test_without_two_kinds_of_labels(spark, urls, verdicts):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.verdict for r in U.url_filter(pages).collect()} == verdicts


def test_too_many_rules_are_refused():
    with pytest.raises(ValueError, match="1000"):
        U.matching_rule(None, None, [("a/", "block")] * 1001)
