"""An index that grows: commits and checkpoints, merges by size, buckets that split, files that go, bounds that save reading."""

import random

import pytest
from brute import brute_of, hits, same
from pyspark.sql import functions as F

import rankspark as R
from rankspark.operators import bounds
from rankspark.operators import search as S
from rankspark.plans import index as X
from rankspark.plans import log as G

TERMS = ["common", "alpha", "rare"]


def entry(number, replaces=(), writing=None, postings=5):
    fields = {"body": {"n_docs": 1, "total_docs": 1, "sum_ttf": 2, "n_postings": postings}}
    holds = {"writing": writing or 1000 + number, "commit": str(number), "buckets": 2, "bytes": 10, "fields": fields}
    return {"segment": number, "replaces": list(replaces), "holds": holds}


def test_opening_reads_one_checkpoint_and_the_tail(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "CHECKPOINT_EVERY", 20)
    log = G.CommitLog(spark, str(tmp_path / "log"))
    for number in range(107):
        log.commit(entry(number))
    read = []
    inner = G.Files.read
    monkeypatch.setattr(G.Files, "read", lambda self, name: read.append(name) or inner(self, name))
    state = G.CommitLog(spark, str(tmp_path / "log")).read()
    assert sorted(state.segments) == list(range(107))
    assert sum(n.endswith(".checkpoint") for n in read) == 1 and len(read) <= 21
    assert len(log.files.names()) < 2 * 20 + 3  # covered commits are gone


def test_state_puts_commits_together():
    state = G.State()
    for number in range(6):
        state.apply({"time": number, **entry(number)})
    state.apply({"time": 10, **entry(9, replaces=[0, 1, 2, 4])})
    state.apply({"time": 11, **entry(3, writing=77)})
    state.apply({"time": 12, "withdraw": 5})
    again = G.State(**__import__("json").loads(state.to_json()))
    assert sorted(again.segments) == [3, 9] and again.segments[3]["writing"] == 77
    assert again.merged == [[0, 2], [4, 4]] and again.is_merged(1) and not again.is_merged(3)
    assert sorted(d[0] for d in again.doomed) == [1000, 1001, 1002, 1003, 1004, 1005]
    again.apply({"time": 13, "removed": [1000, 1005]})
    assert len(again.doomed) == 4


def test_an_entry_is_written_once(spark, tmp_path):
    log = G.CommitLog(spark, str(tmp_path / "log"))
    log.commit(entry(0))
    with pytest.raises(RuntimeError, match="one writer"):
        log.files.write("00000000000000000000.commit", "{}")
    assert sorted(log.read().segments) == [0]


def test_a_thousand_small_appends_leave_few_segments():
    sizes, largest, rewritten, appended = {}, 0, 0, 0
    rng = random.Random(1)
    for number in range(1000):
        sizes[number] = rng.randint(20_000, 90_000)
        appended += sizes[number]
        while chosen := X.size_tiers(sizes, 10):
            merged = sum(sizes.pop(n) for n in chosen)
            rewritten += merged
            sizes[X.COMPACTED + number * 10 + len(chosen)] = merged
        largest = max(largest, len(sizes))
    assert largest < 10 * 4 and rewritten < 4 * appended
    assert sum(sizes.values()) == appended


def test_appends_are_merged_by_size(spark, corpus, tmp_path):
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=2, fanout=3)
    for segment in range(7):
        index.append(corpus.filter(F.col("doc_id") % 7 == segment), segment)
    assert len(index.segments()) < 3 and index.free_segment() == 7
    same(hits(index.search(TERMS, 50)), brute_of(corpus).top(TERMS, 50))
    assert index.was_merged(0) and not index.was_merged(7)
    with pytest.raises(ValueError, match="merged"):
        index.append(corpus, 1)


def test_a_reader_from_before_a_merge_still_answers_until_files_go(spark, corpus, tmp_path):
    path = str(tmp_path / "ix")
    index = R.Index.create(spark, path, analyzer="simple", shards=2)
    for segment in range(2):
        index.append(corpus.filter(F.col("doc_id") % 2 == segment), segment)
    reader, want = R.Index.open(spark, path), brute_of(corpus).top(TERMS, 50)
    index.merge(into=5)
    assert reader.segments() == [0, 1]
    same(hits(reader.search(TERMS, 50)), want)
    assert index.vacuum() == []  # within the grace period
    assert len(_writings(index, "postings-2")) == 3
    assert len(index.vacuum(grace_seconds=0)) == 2
    assert [len(_writings(index, kind)) for kind in ("postings-2", "documents-2", "terms")] == [1, 1, 1]
    reader.refresh()
    for one in (index, reader, R.Index.open(spark, path)):
        assert one.segments() == [5]
        same(hits(one.search(TERMS, 50)), want)


def test_what_failed_writings_leave_goes_too(spark, corpus, tmp_path, monkeypatch):
    index = R.Index.build(spark, str(tmp_path / "ix"), corpus, analyzer="simple", shards=2)
    monkeypatch.setattr(X.CommitLog, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.append(corpus.limit(3), 1)
    monkeypatch.undo()
    assert len(_writings(index, "terms")) == 2
    assert len(index.vacuum(grace_seconds=0)) == 1
    same(hits(index.search(TERMS, 50)), brute_of(corpus).top(TERMS, 50))


def _writings(index, kind):
    return [n for n in index._files.names(kind) if n.startswith("segment=")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_split_as_the_index_grows(spark, corpus, tmp_path, monkeypatch):
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=1, bucket_bytes=2_500, fanout=0)
    index.append(corpus.filter("doc_id % 100 = 0"), 0)
    assert index.buckets == 1
    plans = []
    inner = R.Index._insert
    monkeypatch.setattr(R.Index, "_insert", lambda self, table, rows, *a, **k: plans.append(_plan(rows)) or inner(self, table, rows, *a, **k))
    wide = corpus.filter("doc_id % 100 <> 0").crossJoin(spark.range(20).toDF("n")).select((F.col("doc_id") + 1000 * (F.col("n") + 1)).alias("doc_id"), "text")
    index.append(wide, 1)
    assert index.buckets > 2 and index.buckets & (index.buckets - 1) == 0
    # The rewriting into more buckets exchanges nothing; its two insertions are the last ones.
    assert len(plans) == 4 and all("Exchange" not in plan for plan in plans[2:])
    files = spark.table(index._postings).filter(F.col("segment").isin(index.stats()["writings"])).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n"))
    sizes = [r["n"] for r in files.distinct().collect()]
    assert len(sizes) <= index.buckets and max(sizes) < 2 * 2_500 + 2_000
    all_docs = corpus.filter("doc_id % 100 = 0").union(wide)
    same(hits(index.search(TERMS, 20)), brute_of(all_docs).top(TERMS, 20))
    one = _plan(index.search(TERMS, 10))
    assert one.count("Exchange hashpartitioning") == 1  # documents still share a bucket


def test_dense_scores_read_stored_documents(spark, corpus, tmp_path):
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=3)
    for segment in range(2):
        index.append(corpus.filter(F.col("doc_id") % 2 == segment), segment)
    dense = S.score_all(index.collection(), S.any_of(spark, TERMS))
    plan = _plan(dense)
    assert "Exchange hashpartitioning" not in plan
    assert "HashAggregate" not in _plan(index.collection().lengths) and index._documents in _plan(index.collection().lengths)
    want = brute_of(corpus).scores(TERMS)
    got = {r["doc_id"]: r["score"] for r in dense.collect()}
    assert got == pytest.approx({r["doc_id"]: want.get(r["doc_id"], 0.0) for r in corpus.collect()})


def test_first_buckets_follow_the_size_of_the_input(spark, corpus, tmp_path):
    source = str(tmp_path / "in")
    corpus.write.parquet(source)
    rows = spark.read.parquet(source)
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", bucket_bytes=200)
    assert index._first_buckets(rows) > 4
    # Spark knows nothing of an RDD's size.
    assert R.Index.create(spark, str(tmp_path / "iy"))._first_buckets(spark.createDataFrame(corpus.rdd, corpus.schema)) == 4


# ---- bounds -----------------------------------------------------------------


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Frequent words in all of 150,000 documents, rare ones in a few that lie together."""
    rows = spark.range(150_000).select(
        F.col("id").alias("doc_id"),
        F.concat(
            F.lit("hot warm"),
            F.when(F.col("id") % 2 == 0, F.repeat(F.lit(" pad"), (F.col("id") % 13).cast("int"))).otherwise(""),
            F.when(F.col("id").between(70_000, 70_039), F.repeat(F.lit(" rare"), (F.col("id") % 5 + 1).cast("int"))).otherwise(""),
            F.when(F.col("id") % 30_000 == 7, " lone").otherwise(""),
        ).alias("text"),
    )
    return R.Index.build(spark, str(tmp_path_factory.mktemp("large") / "ix"), rows, analyzer="simple", shards=1)


def _rows_read(df):
    """What the scans of a finished query gave out."""
    df.collect()

    def leaves(plan):
        for at in range(plan.collectLeaves().size()):
            leaf = plan.collectLeaves().apply(at)
            name = leaf.getClass().getSimpleName()
            if name.endswith("QueryStageExec"):
                yield from leaves(leaf.plan())
            elif name == "AdaptiveSparkPlanExec":
                yield from leaves(leaf.executedPlan())
            elif name == "FileSourceScanExec":
                yield leaf.metrics().apply("numOutputRows").value()

    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    return sum(leaves(plan))


@pytest.mark.parametrize("terms", [["hot", "rare"], ["hot", "warm", "rare", "pad"], ["rare", "rare", "hot"], ["lone", "hot"], ["hot", "warm"], ["hot"], ["rare", "lone", "hot"]])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_bounds_change_no_ranking(spark, large, terms, k):
    queries = S.any_of(spark, terms)
    collection = large.collection()
    got = bounds.search_literal(collection, queries, k, skip_from=0).orderBy("rank").collect()
    want = S.search(collection, queries, k).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(got) == k


def test_frequent_terms_are_read_in_part(spark, large):
    queries, collection = S.any_of(spark, ["hot", "warm", "rare"]), large.collection()
    whole = _rows_read(S.search(collection, queries, 10))
    part = _rows_read(bounds.search_literal(collection, queries, 10, skip_from=0))
    assert whole > 300_000 and part < whole / 3
    # Without a threshold that keeps the rest out, nothing is left out.
    none = S.any_of(spark, ["hot", "lone"])
    assert bounds.candidates(collection, none, S.resolve_local(collection, none), 100, None, 0) is None


def test_bounds_with_accepted_documents_and_many_candidates(spark, large, monkeypatch):
    collection, queries = large.collection(), S.any_of(spark, ["hot", "rare"])
    accept = spark.range(70_010, 70_030).toDF("doc_id")
    want = S.search(collection, queries, 5, accept).orderBy("rank").collect()
    for most in (200, 3):
        monkeypatch.setattr(bounds, "PUSHED_DOCS", most)
        got = bounds.search_literal(collection, queries, 5, accept, skip_from=0).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
