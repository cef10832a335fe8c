import math

import pytest
from brute import quantize
from pyspark.sql import functions as F

from rankspark.functions import bm25, geo
from rankspark.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Published partial scores: (df, printed score, tf, length) at N = 1,249,999, avgdl = 22.97202.
GOLDEN = [
    (6, 11.742765, 1, 25), (6, 12.160792, 1, 23), (6, 11.544346, 1, 26), (6, 11.948123, 1, 24),
    (1, 13.873336, 1, 22), (2, 18.489660, 2, 21), (2, 12.664972, 1, 25), (1, 19.209423, 2, 21),
    (5, 11.508395, 1, 27), (5, 11.903997, 1, 25), (5, 12.782815, 1, 21), (5, 11.702853, 1, 26),
    (22, 10.919697, 1, 23), (22, 10.193917, 1, 27), (22, 11.117583, 1, 22), (22, 10.728732, 1, 24),
]


def test_published_partial_scores(spark):
    rows = spark.createDataFrame(GOLDEN, "df long, want double, tf int, dl int")
    idf = bm25.idf(F.col("df"), F.lit(1_249_999))
    norm = bm25.length_norm(bm25.quantize_length(F.col("dl")), F.lit(22.97202))
    for row in rows.select("want", bm25.partial_score(F.col("tf"), norm, idf).alias("got")).collect():
        assert math.isclose(row["got"], row["want"], rel_tol=1e-5)


@pytest.mark.parametrize(
    "df,want", [(35_511, 3.56104), (16_152, 4.34882), (211, 8.68443), (69_229, 2.89347), (9_520, 4.87745)]
)
def test_published_idf(spark, df, want):
    assert one(spark, bm25.idf(F.lit(df), F.lit(1_249_999))) == pytest.approx(want, abs=1e-5)


def test_length_code(spark):
    rows = spark.range(1, 200_000).select("id", bm25.quantize_length(F.col("id")).alias("q"))
    got = {r["id"]: r["q"] for r in rows.collect()}
    assert {n: got[n] for n in (25, 39, 40, 41, 42, 100, 1000, 20000)} == {
        25: 25, 39: 39, 40: 40, 41: 40, 42: 42, 100: 96, 1000: 984, 20000: 18456,
    }
    assert all(q == quantize(n) for n, q in got.items())


def test_simple_tokens(spark):
    assert one(spark, X.tokens(F.lit("It's 3.14, foo_bar Ünï"), "simple")) == [
        "it", "s", "3", "14", "foo", "bar", "ünï",
    ]
    assert one(spark, X.tokens(F.lit(None).cast("string"), "simple")) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("Don't U.S.A 3.14 1,000 a.1 foo_bar", "don't u.s.a 3.14 1,000 a 1 foo_bar"),
        ("日本語 カタカナ ひら", "日 本 語 カタカナ ひ ら"),
        ("__ _x_ x__y", "_x_ x__y"),
        ("a,b 1;2 1:2 a:b", "a b 1;2 1 2 a:b"),
        ("me@site.example.com, end.", "me site.example.com end"),
        ("café naïve", "café naïve"),
        ("", ""),
    ],
)
def test_standard_tokens(spark, text, want):
    assert one(spark, X.tokens(F.lit(text), "standard")) == want.split()


def test_long_runs_are_cut(spark):
    got = one(spark, X.tokens(F.lit("x" * 600), "standard"))
    assert [len(t) for t in got] == [255, 255, 90]


def test_stop_words(spark):
    assert len(X.ENGLISH_STOP_WORDS) == len(set(X.ENGLISH_STOP_WORDS)) == 33
    got = one(spark, X.tokens(F.lit("The cat and the hat cat"), "simple", X.ENGLISH_STOP_WORDS))
    assert got == ["cat", "hat", "cat"]


def test_unknown_analyzer():
    with pytest.raises(ValueError):
        X.tokens("text", "other")


def test_term_counts(spark):
    words = F.array(*[F.lit(w) for w in "b a b c b a".split()])
    got = [(r["term"], r["tf"]) for r in one(spark, X.term_counts(words))]
    assert got == [("a", 2), ("b", 3), ("c", 1)]
    assert one(spark, X.term_counts(F.array().cast("array<string>"))) is None
    assert [tuple(r) for r in one(spark, X.term_counts(F.array(F.lit("z"))))] == [("z", 1)]


def test_tag_cleaning(spark):
    assert one(spark, X.clean_title(F.lit("<title>Wikipedia: A Wikipedia: B</title>"))) == "A B"
    assert one(spark, X.clean_abstract(F.lit("<abstract>x &amp; y</abstract>"))) == "x &amp; y"
    assert one(spark, X.clean_url(F.lit("<url>u</url>"))) == "u"


def test_planar_distance(spark):
    assert one(spark, geo.planar_distance(F.lit(3.0), F.lit(4.0), 0, 0)) == 5.0
