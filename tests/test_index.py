import pytest
from brute import brute_of, hits, same
from pyspark.sql import functions as F

import rankspark as R
from rankspark.operators import search as S
from rankspark.plans.index import file_fingerprint
from rankspark.streaming.ingest import stream_into

TERMS = ["common", "alpha", "rare", "nosuch"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def index(spark, corpus, tmp_path):
    return R.Index.build(spark, str(tmp_path / "ix"), corpus, analyzer="simple", shards=3)


def test_search_equals_brute_force(spark, corpus, index):
    same(hits(index.search(TERMS, 10)), brute_of(corpus).top(TERMS, 10))
    same(hits(index.search(TERMS, -1)), brute_of(corpus).top(TERMS, -1))
    stats = index.stats()
    assert (stats["n_docs"], stats["total_docs"]) == (44, 45)


def test_reopened_index_and_snapshot(spark, corpus, index):
    index.snapshot()
    again = R.Index.open(spark, index.path, analyzer="simple")
    want = brute_of(corpus).top(TERMS, 10)
    same(hits(again.search(TERMS, 10)), want)
    same(hits(again.search(TERMS, 10, snapshot="default")), want)
    rows = {r["term"]: r for r in again.offsets().collect()}
    assert [rows[t]["term_id"] for t in sorted(rows)] == list(range(len(rows)))
    last = rows[max(rows)]
    assert last["end"] == index.stats()["n_postings"]


def test_snapshot_with_whitelist(spark, corpus, index):
    index.snapshot("some", ["common", "rare"])
    got = index.impacts(snapshot="some")
    assert {r["term"] for r in got.select("term").distinct().collect()} == {"common", "rare"}
    same(hits(index.search(TERMS, 5, snapshot="some")), brute_of(corpus).top(["common", "rare"], 5))


def test_segments_add_up(spark, corpus, tmp_path):
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=3)
    for segment in range(3):
        index.append(corpus.filter(F.col("doc_id") % 3 == segment), segment)
    want = brute_of(corpus).top(TERMS, 10)
    same(hits(index.search(TERMS, 10)), want)
    index.append(corpus.filter(F.col("doc_id") % 3 == 1), 1)  # written again, counted once
    same(hits(index.search(TERMS, 10)), want)
    index.merge(into=9)
    assert index.segments() == [9]
    same(hits(index.search(TERMS, 10)), want)
    same(hits(R.Index.open(spark, index.path).search(TERMS, 10)), want)


def test_uncommitted_segment_is_invisible(spark, corpus, index):
    rows = index.spark.table(index._postings).select("doc_id", "term", "tf", "dl", "field")
    index._insert(index._postings, rows, "segment = 5, field", overwrite=False)
    index.refresh()
    assert index.segments() == [0]
    same(hits(index.search(TERMS, 10)), brute_of(corpus).top(TERMS, 10))


def test_failed_rewrite_leaves_the_segment_out(spark, corpus, index, monkeypatch):
    index.append(spark.createDataFrame([(900, "alpha")], "doc_id long, text string"), 1)
    monkeypatch.setattr(R.Index, "_insert", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.append(corpus, 1)
    assert R.Index.open(spark, index.path).segments() == [0]


def test_stale_or_foreign_files_are_refused(spark, corpus, index, tmp_path):
    with pytest.raises(R.StaleIndexError):
        R.Index.open(spark, index.path, analyzer="standard")
    with pytest.raises(R.StaleIndexError):
        R.Index.open(spark, index.path, corpus="another")
    with pytest.raises(R.StaleIndexError):
        index.search(TERMS, snapshot="none")
    index.snapshot()
    index.append(spark.createDataFrame([(900, "alpha")], "doc_id long, text string"), 1)
    with pytest.raises(R.StaleIndexError):
        index.search(TERMS, snapshot="default")
    with pytest.raises(Exception):
        R.Index.create(spark, index.path)


def test_unknown_field(index):
    with pytest.raises(ValueError, match="title"):
        index.search(TERMS, field="title")


def test_fields_are_separate(spark, tmp_path):
    rows = [(1, "title", "red fox"), (1, "body", "blue fox fox"), (2, "body", "red hen")]
    docs = spark.createDataFrame(rows, "doc_id long, field string, text string")
    index = R.Index.build(spark, str(tmp_path / "ix"), docs, analyzer="simple", shards=2)
    assert index.fields() == ["body", "title"]
    assert [d for d, _ in hits(index.search(["red"], field="title"))] == [1]
    assert [d for d, _ in hits(index.search(["red"], field="body"))] == [2]
    assert index.stats("title")["n_docs"] == 1


def test_two_indexes_side_by_side(spark, corpus, index, tmp_path):
    other = R.Index.build(spark, str(tmp_path / "other"), corpus.limit(5), analyzer="simple", shards=2)
    assert other.stats()["total_docs"] == 5
    same(hits(index.search(TERMS, 10)), brute_of(corpus).top(TERMS, 10))


def test_only_the_best_k_are_shuffled(spark, index):
    plan = plan_of(index.search(TERMS, 10))
    main = plan[: plan.index("BroadcastExchange")]
    assert main.count("Exchange hashpartitioning") == 1
    assert main.index("WindowGroupLimit") < main.index("Exchange") < main.index("HashAggregate")
    assert "In(term, [alpha,common,nosuch,rare])" in plan


def test_score_all_needs_no_shuffle(spark, corpus, index):
    assert "Exchange hashpartitioning" not in plan_of(S.score_all(index.collection(), S.any_of(spark, TERMS)))
    got = {r["doc_id"]: r["score"] for r in S.score_all(index.collection(), S.any_of(spark, TERMS)).collect()}
    want = brute_of(corpus).scores(TERMS)
    assert got == pytest.approx({r["doc_id"]: want.get(r["doc_id"], 0.0) for r in corpus.collect()})


def test_streamed_index_equals_batch(spark, corpus, tmp_path):
    source = str(tmp_path / "in")
    corpus.repartition(4).write.parquet(source)
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=2)
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream_into(index, stream, str(tmp_path / "progress")).awaitTermination()
    assert index.segments() == [0, 1]
    same(hits(index.search(TERMS, 10)), brute_of(corpus).top(TERMS, 10))
    corpus.limit(0).write.mode("append").parquet(source)
    stream_into(index, stream, str(tmp_path / "progress")).awaitTermination()
    same(hits(index.search(TERMS, 10)), brute_of(corpus).top(TERMS, 10))


def test_fingerprint_follows_the_files(spark, corpus, tmp_path):
    path = str(tmp_path / "in")
    corpus.write.parquet(path)
    first = file_fingerprint(spark, path)
    assert first == file_fingerprint(spark, path)
    corpus.limit(3).write.mode("append").parquet(path)
    assert first != file_fingerprint(spark, path)


def test_default_analyzer_and_stop_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The U.S.A. don't"), (2, "the the the")], "doc_id long, text string")
    index = R.Index.build(spark, str(tmp_path / "ix"), docs, stop_words=["the"], shards=2)
    assert {r["term"] for r in index.dictionary().collect()} == {"u.s.a", "don't"}
    assert index.stats()["n_docs"] == 1 and index.stats()["total_docs"] == 2


def test_totals_and_matches(spark, corpus, index):
    want = brute_of(corpus).scores(TERMS)
    rows = {r["query_id"]: (r["total_hits"], r["max_score"]) for r in index.totals({0: TERMS, 1: ["nosuch"]}).collect()}
    assert rows[1] == (0, None) and rows[0] == (len(want), pytest.approx(max(want.values())))
    assert {r["doc_id"] for r in index.matches(TERMS).collect()} == set(want)
