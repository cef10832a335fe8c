"""Writing to an index again, after merges, after failures, from streams; stale snapshots; boosts of any size."""

import pytest
from brute import brute_of, hits, same
from pyspark.sql import functions as F

import rankspark as R
from rankspark.operators import batch
from rankspark.operators import search as S
from rankspark.sources.delimited import read_csv_corpus
from rankspark.sources.tagged import page_fields, read_abstracts
from rankspark.streaming.ingest import stream_into

TERMS = ["common", "alpha", "rare"]


@pytest.fixture()
def parts(spark, corpus, tmp_path):
    index = R.Index.create(spark, str(tmp_path / "ix"), analyzer="simple", shards=2)
    for segment in range(2):
        index.append(corpus.filter(F.col("doc_id") % 3 == segment), segment)
    return index


def test_numbers_that_were_merged_away_are_refused(spark, corpus, parts):
    parts.merge(into=2)
    rest = corpus.filter(F.col("doc_id") % 3 == 2)
    for taken in (0, 1):
        with pytest.raises(ValueError, match="merged"):
            parts.append(rest, taken)
        with pytest.raises(ValueError, match="merged"):
            parts.merge(into=taken)
    assert parts.free_segment() == 3
    parts.append(rest, parts.free_segment())
    same(hits(parts.search(TERMS, 50)), brute_of(corpus).top(TERMS, 50))


def test_a_failed_merge_can_be_repeated(spark, corpus, parts, monkeypatch):
    inner = R.Index._insert

    def written_then_lost(self, *args, **kwargs):
        inner(self, *args, **kwargs)
        raise ZeroDivisionError

    monkeypatch.setattr(R.Index, "_insert", written_then_lost)
    with pytest.raises(ZeroDivisionError):
        parts.merge(into=2)
    monkeypatch.setattr(R.Index, "_insert", inner)
    assert parts.segments() == [0, 1]
    want = brute_of(corpus.filter(F.col("doc_id") % 3 < 2)).top(TERMS, 50)
    same(hits(parts.search(TERMS, 50)), want)
    parts.merge(into=2)
    assert parts.segments() == [2]
    same(hits(parts.search(TERMS, 50)), want)


def test_only_committed_segments_are_merged(parts):
    parts.merge(into=2)
    with pytest.raises(ValueError, match="not committed"):
        parts.merge(into=3, segments=[0, 1, 2])
    with pytest.raises(ValueError, match="not committed"):
        parts.merge(into=3, segments=[2, 77])


def test_streams_add_to_what_is_there(spark, corpus, tmp_path):
    index = R.Index.build(spark, str(tmp_path / "ix"), corpus.filter("doc_id % 3 = 0"), analyzer="simple", shards=2)
    for k in (1, 2):
        source = str(tmp_path / f"in{k}")
        corpus.filter(f"doc_id % 3 = {k}").write.parquet(source)
        for _ in range(2):  # the second time nothing is new
            stream = spark.readStream.schema(corpus.schema).parquet(source)
            stream_into(index, stream, str(tmp_path / f"progress{k}")).awaitTermination()
    assert index.segments() == [0, 1_000_000, 2_000_000]
    same(hits(index.search(TERMS, 50)), brute_of(corpus).top(TERMS, 50))


def test_a_rewritten_segment_makes_snapshots_stale(spark, corpus, parts):
    parts.snapshot()
    parts.append(corpus.filter(F.col("doc_id") % 3 == 1), 1)
    with pytest.raises(R.StaleIndexError, match="other segments"):
        parts.search(TERMS, snapshot="default")
    parts.snapshot()
    assert hits(parts.search(TERMS, 5, snapshot="default"))


def test_a_snapshot_knows_its_vocabulary(spark, parts):
    parts.snapshot("some", ["common", "rare"])
    assert hits(parts.search(["common"], snapshot="some", vocabulary=["rare", "common", "rare"]))
    for other in (None, ["common"]):
        with pytest.raises(R.StaleIndexError, match="vocabulary"):
            parts.search(["common"], snapshot="some", vocabulary=other)
    words = spark.createDataFrame([("common",)], "term string")
    parts.snapshot("table", words)
    assert hits(parts.search(["common"], snapshot="table", vocabulary=words))


@pytest.mark.parametrize("boost", [1e-7, 1.0, 1e7])
@pytest.mark.parametrize("blocks", [False, True])
def test_order_does_not_depend_on_the_size_of_scores(spark, corpus, monkeypatch, boost, blocks):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 0 if blocks else 10**12)
    collection = S.Collection.from_documents(corpus, "simple")
    table = spark.createDataFrame([(0, t, boost) for t in TERMS], "query_id long, term string, boost double")
    found = batch.search_batch(collection, S.any_of(spark, table), 12).orderBy("rank").collect()
    want = S.search(collection, S.any_of(spark, TERMS), 12).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in want]
    assert [r.score for r in found] == pytest.approx([r.score * boost for r in want])


@pytest.mark.parametrize("blocks", [False, True])
def test_null_boosts_are_one(spark, corpus, monkeypatch, blocks):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 0 if blocks else 10**12)
    collection = S.Collection.from_documents(corpus, "simple")
    table = spark.createDataFrame([(0, "common", None), (0, "rare", 2.0)], "query_id long, term string, boost double")
    plain = spark.createDataFrame([(0, "common", 1.0), (0, "rare", 2.0)], "query_id long, term string, boost double")
    got, want = (batch.search_batch(collection, S.any_of(spark, t), 50).collect() for t in (table, plain))
    assert sorted(got) == sorted(want) and got


def test_equal_terms_keep_the_largest_boost_and_queries_can_be_boosted(spark):
    table = spark.createDataFrame([(0, "a", 1.0), (0, "a", 3.0), (0, "b", 2.0)], "query_id long, term string, boost double")
    queries = S.any_of(spark, table)
    assert sorted((r.term, r.boost) for r in queries.distinct_terms().frame.collect()) == [("a", 3.0), ("b", 2.0)]
    assert sorted(r.boost for r in S.any_of(spark, queries, boost=2.0).frame.collect()) == [2.0, 4.0, 6.0]


def test_rank_has_one_type(spark, corpus):
    collection = S.Collection.from_documents(corpus, "simple")
    kinds = {S.search(collection, S.any_of(spark, TERMS), k).schema["rank"].dataType.simpleString() for k in (10, 1000, 1001, -1)}
    assert kinds == {"bigint"}


def test_a_task_hands_on_the_best_k_of_all_its_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(batch, "VECTORIZE_FROM", 0)
    monkeypatch.setattr(batch, "BLOCK_CELLS", 4)
    handed_on = []
    monkeypatch.setattr(S, "rank", lambda found, k: handed_on.append(found) or found)
    table = spark.createDataFrame([(q, "common") for q in range(4)], "query_id long, term string")
    collection = S.Collection.from_documents(corpus.coalesce(1), "simple")
    found = batch.search_batch(collection, S.any_of(spark, table), 2)
    tasks = spark.sparkContext.defaultParallelism
    assert found.count() <= 2 * 4 * max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert found.groupBy("query_id", F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("blocks", [False, True])
def test_queries_too_many_to_broadcast_are_taken_in_chunks(spark, corpus, monkeypatch, blocks):
    rows = [(q, t) for q in range(40) for t in (["common", "alpha"] if q % 2 else ["rare", "beta", "nosuch"])] + [(99, f"word{i}") for i in range(60)]
    table = spark.createDataFrame(rows, "query_id long, term string")
    collection = S.Collection.from_documents(corpus, "simple")
    want = sorted(S.search(collection, S.any_of(spark, table), 3).select("query_id", "rank", "doc_id").collect())
    monkeypatch.setattr(S, "measured_small", lambda frame: frame.count() <= 30)
    monkeypatch.setattr(batch, "CHUNK_ROWS", 10)
    found = batch.search_chunks(collection, S.any_of(spark, table), 3, vectorize_from=0 if blocks else 10**12)
    assert sorted(found.select("query_id", "rank", "doc_id").collect()) == want


def test_every_abstract_of_a_record(spark, tmp_path):
    text = (
        "<doc>\n<title>Wikipedia: T1</title>\n<abstract>the first long abstract</abstract>\n<title>Wikipedia: T2</title>\n"
        "<abstract>the second long abstract</abstract>\n<abstract>the third long abstract</abstract>\n</doc>\n"
        "<doc>\n<abstract>an abstract without title</abstract>\n</doc>"
    )
    (tmp_path / "dump.xml").write_text(text)
    got = sorted((r.title, r.desc) for r in read_abstracts(spark, str(tmp_path / "dump.xml")).collect())
    # The last title seen holds on, also in a record without one.
    assert got == [("T1", "the first long abstract"), ("T2", "an abstract without title"), ("T2", "the second long abstract"), ("T2", "the third long abstract")]


def test_page_text_around_scripts_and_headers(spark):
    html = "<head><title>T</title></head><header>top</header><p>one</p><script>x</style></script><p>two</p><STYLE>y</STYLE >three"
    got = page_fields(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert (got.title, got.desc) == ("T", "top one two three")


def test_quotes_behind_backslashes(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,title,text\n1,a,"say \\"hi\\", twice"\n')
    assert [r.text for r in read_csv_corpus(spark, str(tmp_path / "c.csv"), escape="\\").collect()] == ['say "hi", twice']


def test_the_standard_analyzer_leaves_out_stop_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The fox and the hen")], "doc_id long, text string")
    assert R.Index.build(spark, str(tmp_path / "a"), docs, shards=1).stats()["sum_ttf"] == 2
    assert R.Index.build(spark, str(tmp_path / "b"), docs, shards=1, analyzer="simple").stats()["sum_ttf"] == 5
    assert R.Index.build(spark, str(tmp_path / "c"), docs, shards=1, stop_words=()).stats()["sum_ttf"] == 5
