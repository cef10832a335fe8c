import random
from dataclasses import replace

import pytest
from brute import brute_of, hits, same
from pyspark.sql import functions as F

from rankspark.operators import batch
from rankspark.operators import search as S


@pytest.fixture(autouse=True)
def always_in_blocks(monkeypatch):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 0)


@pytest.fixture()
def by_id():
    rng = random.Random(3)
    words = ["common", "alpha", "beta", "rare", "gamma", "one", "nosuch"] + [f"word{i}" for i in range(20)]
    return {i: rng.choices(words, k=rng.randrange(1, 9)) for i in range(30)}


def table_of(spark, by_id, kind="long"):
    rows = [(i if kind == "long" else f"q{i}", t) for i, terms in by_id.items() for t in terms]
    return S.any_of(spark, spark.createDataFrame(rows, f"query_id {kind}, term string"))


def check(df, want, by_id, k, **options):
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    for i, terms in by_id.items():
        same(hits(df, i), want.top(terms, k, **options))


@pytest.mark.parametrize("pairs,cells", [(4_000_000, 8_000_000), (40, 8_000_000), (4_000_000, 60), (1, 1)])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_blocks_equal_brute_force(spark, corpus, by_id, monkeypatch, pairs, cells, k):
    monkeypatch.setattr(batch, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(batch, "BLOCK_CELLS", cells)
    collection = S.Collection.from_documents(corpus, "simple")
    df = batch.search_batch(collection, table_of(spark, by_id), k).cache()
    check(df, brute_of(corpus), by_id, k)
    df.unpersist()


def test_sparse_blocks(spark, corpus):
    by_id = {i: ["rare"] if i else ["gamma"] for i in range(400)}
    df = batch.search_batch(S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id), 3)
    rows = df.collect()
    assert len(rows) == 400 and {r["rank"] for r in rows} == {1}


def test_accepted_documents(spark, corpus, by_id):
    accept = corpus.filter(F.col("doc_id") % 3 == 0)
    df = batch.search_batch(S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id), 5, accept).cache()
    check(df, brute_of(corpus), by_id, 5, accept=set(range(0, 100, 3)))
    df.unpersist()


def test_text_query_ids(spark, corpus, by_id):
    df = batch.search_batch(S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id, "string"), 5)
    same(hits(df, "q7"), brute_of(corpus).top(by_id[7], 5))


def test_other_cases_go_the_general_way(spark, corpus, by_id):
    collection = S.Collection.from_documents(corpus, "simple")
    queries = table_of(spark, by_id)
    for other, k in ((queries.boosted(-1.0), 3), (replace(queries, small=False), 3), (queries, -1)):
        df = batch.search_batch(collection, other, k)
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    none = table_of(spark, {0: ["nosuch"]})
    assert batch.search_batch(collection, none, 3).collect() == []


def test_small_batches_stay_in_expressions(spark, corpus, by_id, monkeypatch):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 1_000_000)
    df = batch.search_batch(S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id), 4)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    same(hits(df, 5), brute_of(corpus).top(by_id[5], 4))


def _totals(rows):
    return {r["query_id"]: (r["total_hits"], r["max_score"]) for r in rows}


@pytest.mark.parametrize("cells", [8_000_000, 60, 1])
def test_totals_and_matches_in_blocks(spark, corpus, by_id, monkeypatch, cells):
    monkeypatch.setattr(batch, "BLOCK_CELLS", cells)
    collection, queries = S.Collection.from_documents(corpus, "simple"), table_of(spark, {**by_id, 99: ["nosuch"]})
    counted = batch.total_hits(collection, queries)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    want = brute_of(corpus)
    got = _totals(counted.collect())
    assert got.keys() == {*by_id, 99} and got[99] == (0, None)
    for i, terms in by_id.items():
        scores = want.scores(terms)
        assert got[i][0] == len(scores)
        assert got[i][1] == (pytest.approx(max(scores.values())) if scores else None)
    pairs = {tuple(r) for r in batch.match_only(collection, queries).select("query_id", "doc_id").collect()}
    assert pairs == {(i, d) for i, terms in by_id.items() for d in want.scores(terms)}


def test_counts_are_one_row_per_query_and_task(spark, corpus, by_id):
    collection, queries = S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id)
    table = S.resolve_local(collection, queries)
    blocks = batch.Blocks.of(collection, queries, table, None)
    rows = blocks.run(batch.count_kernel, batch.COUNTS_SCHEMA).withColumn("task", F.spark_partition_id())
    assert rows.groupBy("query_id", "task").count().agg(F.max("count")).first()[0] == 1
    assert rows.agg(F.sum("hits")).first()[0] > 5 * rows.count()


def test_totals_and_matches_the_general_way(spark, corpus, by_id, monkeypatch):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 1_000_000)
    collection, queries = S.Collection.from_documents(corpus, "simple"), table_of(spark, by_id)
    wide = replace(queries, small=False)
    assert "MapInArrow" not in batch.total_hits(collection, queries)._jdf.queryExecution().executedPlan().toString()
    assert _totals(batch.total_hits(collection, queries).collect()) == _totals(batch.total_hits(collection, wide).collect())
    assert set(batch.match_only(collection, queries).collect()) == set(batch.match_only(collection, wide).collect())


def test_query_rows_are_copied_as_often_as_their_terms_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_POSTINGS", 100)
    rows = [(i, "hot") for i in range(1050)] + [(i, "warm") for i in range(150)] + [(i, "rare") for i in range(3)]
    postings = spark.createDataFrame(rows, "doc_id long, term string")
    weights = spark.createDataFrame([(q, t, n) for q in range(4) for t, n in (("hot", 1050), ("warm", 150), ("rare", 3))], "query_id int, term string, df long")
    splits, whole = S.split_counts(weights.select("term", "df").distinct())
    assert whole == 100 and sorted(r["_splits"] for r in splits.collect()) == [2, 11]
    queries = replace(S.any_of(spark, ["hot"]), small=False)
    joined = S._with_query(postings, weights, queries)
    assert joined.count() == 4 * len(rows)
    assert set(joined.columns) == {"term", "doc_id", "query_id", "df"}
    plan = joined._jdf.queryExecution().toString()
    assert "sequence" in plan and "64" not in plan.split("sequence")[1][:40]


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_sums_do_not_depend_on_their_order(spark, partitions):
    """Thirds add up to borders of seven digits; every document has the same ones, in another order."""
    parts = [1 / 3, 1e-7, 2 / 3, 16777216.5, 1e-9, 0.1, 0.2, 1 / 7] * 3
    rows = []
    for doc in range(40):
        order = parts[:]
        random.Random(doc).shuffle(order)
        rows += [(0, doc, p, 2.0**30) for p in order]
    gathered = spark.createDataFrame(rows, "query_id int, doc_id long, partial double, unit double").repartition(partitions)
    found = S.sum_partials(gathered).collect()
    assert len({(r["score"], r["key"]) for r in found}) == 1
    ranked = S.rank(S.sum_partials(gathered), 40).orderBy("rank").collect()
    assert [r["doc_id"] for r in ranked] == list(range(40))


def test_tiny_boosts_rank_as_others(spark, corpus):
    collection = S.Collection.from_documents(corpus, "simple")
    plain = S.search(collection, S.any_of(spark, ["alpha", "gamma", "common"]), 10).collect()
    tiny = S.search(collection, S.any_of(spark, ["alpha", "gamma", "common"]).boosted(1e-50), 10).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(tiny, key=lambda r: r["rank"])] == [(r["rank"], r["doc_id"]) for r in sorted(plain, key=lambda r: r["rank"])]


def test_chunks_release_what_they_held(spark, corpus, by_id, monkeypatch):
    monkeypatch.setattr(batch, "CHUNK_ROWS", 40)
    collection = S.Collection.from_documents(corpus, "simple")
    wide = replace(table_of(spark, by_id), small=False)
    hits_ = batch.search_chunks(collection, wide, 4)
    plan = hits_._jdf.queryExecution().executedPlan().toString()
    # Only written hits are left: neither weights nor term tables.
    assert "Broadcast" not in plan and "LocalTableScan" not in plan and "MapInArrow" not in plan
    rows = hits_.collect()
    want = brute_of(corpus)
    for i, terms in by_id.items():
        got = [(r["doc_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i]
        same(got, want.top(terms, 4))
