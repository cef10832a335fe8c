from dataclasses import replace

import pytest
from brute import brute_of, hits, same
from pyspark.sql import functions as F

from rankspark.operators import compare
from rankspark.operators import postings as P
from rankspark.operators import search as S

TERMS = ["common", "alpha", "rare", "nosuch"]


@pytest.fixture()
def collection(corpus):
    return S.Collection.from_documents(corpus, "simple")


def test_top_k_equals_brute_force(spark, corpus, collection):
    want = brute_of(corpus)
    for terms in (TERMS, ["gamma"], ["one", "two"], ["common"]):
        same(hits(S.search(collection, S.any_of(spark, terms), 7)), want.top(terms, 7))


@pytest.mark.parametrize("options", [{"quantize": False}, {"use_norms": False}, {"k1": 2.0, "b": 0.3}])
def test_options(spark, corpus, collection, options):
    renamed = {("quantized" if k == "quantize" else k): v for k, v in options.items()}
    got = S.search(collection.with_options(**options), S.any_of(spark, TERMS), 10)
    same(hits(got), brute_of(corpus, **renamed).top(TERMS, 10))


def test_unlimited_and_long_rankings(spark, corpus, collection):
    queries = S.any_of(spark, {0: TERMS, 1: ["alpha"]})
    want = brute_of(corpus)
    everything = S.search(collection, queries, -1)
    same(hits(everything, 0), want.top(TERMS, -1))
    same(hits(everything, 1), want.top(["alpha"], -1))
    top = S.search(collection, queries, S.WINDOW_K + 1)
    same(hits(top, 0), want.top(TERMS, -1))


def test_long_k_cuts(spark, corpus, collection, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_K", 2)
    same(hits(S.search(collection, S.any_of(spark, TERMS), 5)), brute_of(corpus).top(TERMS, 5))


def test_edge_queries(spark, collection):
    def run(terms, k=10):
        return S.search(collection, S.any_of(spark, terms), k).collect()

    assert run(["nosuch"]) == []
    assert run([]) == []
    assert run(["Common"]) == []
    assert run(TERMS, 0) == []
    assert len(run(["rare"], 1000)) == 1


def test_totals_keep_queries_without_hits(spark, corpus, collection):
    queries = S.any_of(spark, {0: TERMS, 1: ["nosuch"], 2: []})
    got = {r["query_id"]: (r["total_hits"], r["max_score"]) for r in S.totals(S.scores(collection, queries), queries).collect()}
    want = brute_of(corpus).scores(TERMS)
    assert got[0] == (len(want), pytest.approx(max(want.values())))
    assert got[1] == got[2] == (0, None)


def test_repeats_boosts_and_distinct(spark, corpus, collection):
    want = brute_of(corpus)
    twice = S.any_of(spark, ["alpha", "alpha", "rare"])
    same(hits(S.search(collection, twice, 5)), want.top(["alpha", "alpha", "rare"], 5))
    same(hits(S.search(collection, twice.distinct_terms(), 5)), want.top(["alpha", "rare"], 5))
    boosted = hits(S.search(collection, twice.boosted(2.0), 5))
    assert [s for _, s in boosted] == pytest.approx([2 * s for _, s in want.top(["alpha", "alpha", "rare"], 5)])


def test_accept_keeps_statistics(spark, corpus, collection):
    accept = corpus.filter(F.col("doc_id") % 2 == 0)
    got = S.search(collection, S.any_of(spark, TERMS), 10, accept)
    same(hits(got), brute_of(corpus).top(TERMS, 10, accept=set(range(0, 100, 2))))


def test_whitelist_keeps_partials(spark, collection):
    full = {(r["term"], r["doc_id"]): r["partial"] for r in S.impacts(collection).collect()}
    words = ["common", "rare"]
    for vocabulary in (words, spark.createDataFrame([(w,) for w in words], "term string")):
        part = {(r["term"], r["doc_id"]): r["partial"] for r in S.impacts(collection, vocabulary).collect()}
        assert part == {k: v for k, v in full.items() if k[0] in words}
    assert S.impacts(collection, []).count() == len(full)


def test_batch_equals_one_by_one(spark, corpus, collection):
    by_id = {i: [f"word{i}", "common", "alpha"] for i in range(8)}
    batch = S.search(collection, S.any_of(spark, by_id), 6)
    rows = [(i, t) for i, terms in by_id.items() for t in terms]
    from_table = S.search(collection, S.any_of(spark, spark.createDataFrame(rows, "query_id long, term string")), 6)
    for i, terms in by_id.items():
        single = hits(S.search(collection, S.any_of(spark, terms), 6))
        same(hits(batch, i), single)
        same(hits(from_table, i), single)


def test_too_many_queries_to_broadcast(spark, corpus, collection):
    queries = replace(S.any_of(spark, {0: TERMS, 1: ["alpha", "beta"]}), small=False, literal=None)
    got = S.search(collection, queries, 10)
    want = brute_of(corpus)
    same(hits(got, 0), want.top(TERMS, 10))
    same(hits(got, 1), want.top(["alpha", "beta"], 10))
    assert S.match_only(collection, queries).filter("query_id = 0").count() == len(want.scores(TERMS))


def test_explain_adds_up(spark, collection):
    queries = S.any_of(spark, TERMS)
    top = S.search(collection, queries, 5)
    parts = S.explain(collection, queries, top).groupBy("doc_id").agg(F.sum("partial").alias("s"))
    got = {r["doc_id"]: r["s"] for r in parts.collect()}
    assert got == pytest.approx(dict(hits(top)))


def test_score_all(spark, corpus, collection):
    got = {r["doc_id"]: r["score"] for r in S.score_all(collection, S.any_of(spark, TERMS)).collect()}
    want = brute_of(corpus).scores(TERMS)
    assert got == pytest.approx({r["doc_id"]: want.get(r["doc_id"], 0.0) for r in corpus.collect()})
    with pytest.raises(ValueError):
        S.score_all(collection, S.any_of(spark, {0: ["a"], 1: ["b"]}))


def test_candidate_size(spark, corpus, collection):
    got = S.candidate_size(collection, S.any_of(spark, {0: ["alpha", "alpha", "rare"], 1: ["nosuch"]})).collect()
    df = brute_of(corpus).df
    assert {r["query_id"]: r["candidates"] for r in got} == {0: 2 * df["alpha"] + df["rare"], 1: 0}


@pytest.mark.parametrize("query", ["text", {"a": ["x"]}, [["x"]], [1], 5, {0: "x"}, [{"must": "x"}]])
def test_other_query_shapes_are_refused(spark, query):
    with pytest.raises(ValueError):
        S.any_of(spark, query)


def test_query_table_needs_its_columns(spark):
    with pytest.raises(ValueError):
        S.any_of(spark, spark.createDataFrame([("x",)], "term string"))


def test_empty_documents_do_not_count(spark, corpus):
    stats = P.collection_stats(P.doc_lengths(P.tokenize(corpus, "simple"))).first()
    want = brute_of(corpus)
    assert (stats["n_docs"], stats["avgdl"]) == (want.n, pytest.approx(want.avgdl))


def test_compare(spark, collection):
    queries = S.any_of(spark, TERMS)
    a = S.search(collection, queries, 5)
    row = compare.overlap(a, a).first()
    assert (row["shared"], row["left_hits"], row["max_score_delta"]) == (5, 5, 0.0)
    b = S.search(collection, queries, 3)
    assert compare.overlap(a, b).first()["shared"] == 3
    assert compare.compare_hits(a, b).filter("right_rank is null").count() == 2


def test_tokenizing_happens_once_per_document(spark, corpus):
    plan = P.build_postings(P.tokenize(corpus, "simple"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "Exchange" not in plan
