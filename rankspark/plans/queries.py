"""Every operator as a named query over the test tables.

Each query reads whole tables. Retrieval queries share one index per session
and source directory, built on first use in a scratch folder and rebuilt when
the source files change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions import text as X
from ..operators import batch, compare, nearest
from ..operators import dictionary as D
from ..operators import documents as docs_ops
from ..operators import postings as P
from ..operators import search as S
from ..operators.batch import search_chunks
from ..operators.scale import scratch_dir, spread, take_first, with_positions
from ..sources.delimited import read_csv_corpus, read_numbered_csv_corpus
from ..sources.points import points_from_vectors
from ..sources.tagged import page_fields, read_abstracts, read_xml_abstracts
from ..streaming.ingest import stream_into
from .index import Index, file_fingerprint

# ---- fixed values: the test queries and parameters -----------------------
TERMS = ["the", "of", "anshwh", "nosuch"]
REPEATED = ["the", "the", "anshwh"]
WHITELIST = ["the", "anshwh"]
SEVERAL = {0: TERMS, 1: ["nosuch"], 2: [], 3: ["The"], 4: ["und", "der", "the"]}
K = 10
BOOST = 2.0
SMALL_BOOST = 1e-7
POINT = (0.1, -0.2)
SEGMENTS = 4
SIMPLE = "simple"
# --------------------------------------------------------------------------

_INDEXES: dict[tuple[str, str, str], Index] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def shared_index(spark: SparkSession, sf_dir: str) -> Index:
    print_of = file_fingerprint(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, print_of)
    if key not in _INDEXES:
        path = f"{scratch_dir(spark)}/index"
        _INDEXES[key] = Index.build(spark, path, documents(spark, sf_dir), analyzer=SIMPLE, corpus=print_of)
    return _INDEXES[key]


def batch_queries(spark: SparkSession, sf_dir: str) -> S.Queries:
    """Every ``benchmark`` row as a query of its distinct tokens."""
    texts = table(spark, sf_dir, "benchmark")
    return S.any_of(spark, S.queries_from_text(texts, "item_id", X.tokens("text", SIMPLE)))


def _tokens(spark: SparkSession, sf_dir: str, stop_words=()) -> DataFrame:
    return P.tokenize(spread(documents(spark, sf_dir), "doc_id"), SIMPLE, stop_words)


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_from_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields(table(spark, sf_dir, "pages"))


# ---- sources, projections, filters, ids ----------------------------------


def scan_limit(spark, sf_dir):
    return take_first(documents(spark, sf_dir), [F.col("doc_id")], 41)


def csv_roundtrip(spark, sf_dir):
    path = f"{scratch_dir(spark)}/corpus"
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, compression="gzip")
    texts = read_csv_corpus(spark, path)
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(
        F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"), "copies"
    )


def abstracts_roundtrip(spark, sf_dir):
    path = f"{scratch_dir(spark)}/abstracts"
    fields = _pages(spark, sf_dir)
    pair = [F.lit("<title>Wikipedia: "), "title", F.lit("</title>\n<url>u</url>\n<abstract>"), "desc", F.lit("</abstract>\n")]
    # Every other record has a second title and abstract.
    second = F.concat(F.lit("<title>Wikipedia: more of "), "title", F.lit("</title>\n<abstract>again "), "desc", F.lit("</abstract>\n"))
    more = F.when(F.col("page_id") % 2 == 0, second).otherwise("")
    fields.select(F.concat(F.lit("<doc>\n"), *pair, more, F.lit("</doc>")).alias("value")).write.text(path)
    return read_abstracts(spark, path).groupBy("title", "desc").agg(F.count(F.lit(1)).alias("copies"))


def csv_split(spark, sf_dir):
    """Plain CSV with newlines in quotes, its files shared by tasks; records in the order of doc_id."""
    path = f"{scratch_dir(spark)}/split"
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").select("source", "lang", "text", "doc_id")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    texts = read_numbered_csv_corpus(spark, path)
    return texts.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def abstracts_carry(spark, sf_dir):
    """A dump without records: pages in order, every third with a title line, each with an abstract line."""
    path = f"{scratch_dir(spark)}/carry"
    title = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("<title>Wikipedia: "), "title", F.lit("</title>\n"))).otherwise("")
    lines = F.concat(title, F.lit("<abstract>"), F.concat("page_id", F.lit(" "), "desc"), F.lit("</abstract>"))
    _pages(spark, sf_dir).orderBy("page_id").select(lines.alias("value")).write.text(path)
    return read_abstracts(spark, path, one_dump=True)


def csv_numbered(spark, sf_dir):
    """Ordinals follow the files' order; the files are written in the order of doc_id."""
    path = f"{scratch_dir(spark)}/numbered"
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").select("source", "lang", "text")
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, compression="gzip")
    texts = read_numbered_csv_corpus(spark, path)
    return texts.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def xml_abstracts(spark, sf_dir):
    path = f"{scratch_dir(spark)}/xml"
    fields = _pages(spark, sf_dir).select(F.concat(F.lit("Wikipedia: "), "title").alias("title"), F.col("desc").alias("abstract"))
    fields.write.format("xml").option("rowTag", "doc").option("rootTag", "feed").save(path)
    return read_xml_abstracts(spark, path).groupBy("title", "desc").agg(F.count(F.lit(1)).alias("copies"))


def extract_title_desc(spark, sf_dir):
    return _pages(spark, sf_dir)


def strip_title(spark, sf_dir):
    whole = F.regexp_extract("html", r"(?is)<title[^>]*>.*?</title>", 0)
    return table(spark, sf_dir, "pages").select("page_id", X.clean_title(whole).alias("title"))


def filter_min_length(spark, sf_dir):
    return docs_ops.min_length(_pages(spark, sf_dir), "title", 50).select("page_id", "title")


def assign_doc_ids(spark, sf_dir):
    return docs_ops.assign_ids(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])


def segment_offsets(spark, sf_dir):
    return docs_ops.segment_offsets(table(spark, sf_dir, "documents"), "source")


# ---- text analysis --------------------------------------------------------


def _joined(tokenized):
    return tokenized.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def tokenize(spark, sf_dir):
    return _joined(_tokens(spark, sf_dir))


def tokenize_stopwords(spark, sf_dir):
    return _joined(_tokens(spark, sf_dir, X.ENGLISH_STOP_WORDS))


def tokenize_standard(spark, sf_dir):
    return _joined(P.tokenize(spread(documents(spark, sf_dir), "doc_id"), "standard", X.ENGLISH_STOP_WORDS))


def term_freq(spark, sf_dir):
    return P.build_postings(_tokens(spark, sf_dir)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def multi_field_df(spark, sf_dir):
    fields = docs_ops.as_fields(_pages(spark, sf_dir), "page_id", {"title": "title", "body": "desc"})
    return P.doc_freq(P.build_postings(P.tokenize(fields, SIMPLE)))


# ---- statistics and index build -------------------------------------------


def doc_length(spark, sf_dir):
    return P.doc_lengths(_tokens(spark, sf_dir)).select("doc_id", F.col("dl").cast("long").alias("dl"))


def length_quantized(spark, sf_dir):
    dl = F.col("dl").cast("long")
    return P.doc_lengths(_tokens(spark, sf_dir)).select(
        "doc_id", dl.alias("dl"), bm25.quantize_length(dl).alias("len")
    )


def collection_stats(spark, sf_dir):
    return _six(P.collection_stats(P.doc_lengths(_tokens(spark, sf_dir))), "avgdl")


def doc_freq(spark, sf_dir):
    return P.doc_freq(P.build_postings(_tokens(spark, sf_dir)))


def idf(spark, sf_dir):
    tokenized = _tokens(spark, sf_dir)
    n_docs = P.collection_stats(P.doc_lengths(tokenized)).select("n_docs").scalar()
    counted = P.doc_freq(P.build_postings(tokenized))
    return counted.select("term", "df", F.round(bm25.idf(F.col("df"), n_docs), 6).alias("idf"))


def length_norm(spark, sf_dir):
    lengths = P.doc_lengths(_tokens(spark, sf_dir))
    avgdl = P.collection_stats(lengths).select("avgdl").scalar()
    norm = bm25.length_norm(bm25.quantize_length(F.col("dl")), avgdl)
    return lengths.select("doc_id", F.round(norm, 6).alias("norm"))


def impacts(spark, sf_dir):
    index = shared_index(spark, sf_dir)
    n_postings = index.stats()["n_postings"]
    return _six(S.impacts(index.collection(), n_postings=n_postings), "partial")


def posting_lists(spark, sf_dir):
    return P.posting_lists(P.build_postings(_tokens(spark, sf_dir)))


def term_dictionary(spark, sf_dir):
    counted = P.doc_freq(P.build_postings(_tokens(spark, sf_dir)))
    return D.term_dictionary(counted).select("term", "term_id", "df")


def term_offsets(spark, sf_dir):
    counted = P.doc_freq(P.build_postings(_tokens(spark, sf_dir)))
    return D.term_dictionary(counted).select("term", "start", "end")


def index_summary(spark, sf_dir):
    index = shared_index(spark, sf_dir)
    total = F.lit(index.stats()["total_docs"]).cast("long").alias("total_docs")
    return D.index_summary(index.dictionary()).select(total, "n_terms", "n_postings")


def impact_sample(spark, sf_dir):
    rows = S.impacts(shared_index(spark, sf_dir).collection())
    return _six(take_first(rows, [F.col("term"), F.col("doc_id")], 20), "partial")


def _segmented_index(spark, sf_dir) -> Index:
    index = Index.create(spark, f"{scratch_dir(spark)}/index", analyzer=SIMPLE)
    rows = documents(spark, sf_dir)
    for segment in range(SEGMENTS):
        index.append(rows.filter(F.pmod("doc_id", F.lit(SEGMENTS)) == segment), segment)
    return index


def merge_segments(spark, sf_dir):
    index = _segmented_index(spark, sf_dir)
    index.merge(into=SEGMENTS)
    assert index.segments() == [SEGMENTS]
    merged = index.collection().postings
    return merged.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf"))


def incremental_equals_full(spark, sf_dir):
    index = _segmented_index(spark, sf_dir)
    return _six(index.search(batch_queries(spark, sf_dir), K), "score")


def stream_ingest(spark, sf_dir):
    where = scratch_dir(spark)
    index = Index.create(spark, f"{where}/index", analyzer=SIMPLE)
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, as a stream's plain path has to be a folder; the table may be a file or a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{{documents}}.parquet")
    stream_into(index, stream.select("doc_id", "text"), f"{where}/progress").awaitTermination()
    return index.dictionary()


def append_after_merge(spark, sf_dir):
    """A segment added after a merge, under a free number, is found with the merged ones."""
    index = Index.create(spark, f"{scratch_dir(spark)}/index", analyzer=SIMPLE)
    rows = documents(spark, sf_dir)
    for segment in (0, 1):
        index.append(rows.filter(F.pmod("doc_id", F.lit(3)) == segment), segment)
    index.merge(into=2)
    index.append(rows.filter(F.pmod("doc_id", F.lit(3)) == 2), index.free_segment())
    return index.dictionary()


def stream_into_built_index(spark, sf_dir):
    """A stream into an index that holds documents already adds to them."""
    where = scratch_dir(spark)
    rows = documents(spark, sf_dir)
    index = Index.build(spark, f"{where}/index", rows.filter("doc_id % 2 = 0"), analyzer=SIMPLE)
    rows.filter("doc_id % 2 = 1").write.parquet(f"{where}/incoming")
    stream = spark.readStream.schema(rows.schema).parquet(f"{where}/incoming")
    stream_into(index, stream, f"{where}/progress").awaitTermination()
    return index.dictionary()


def index_roundtrip(spark, sf_dir):
    built = shared_index(spark, sf_dir)
    built.snapshot("roundtrip")
    opened = Index.open(spark, built.path, analyzer=SIMPLE, corpus=built.manifest["corpus"])
    stored = opened.impacts(snapshot="roundtrip").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("partial"), 4).alias("total")
    )
    return opened.offsets(snapshot="roundtrip").join(stored, "term")


# ---- joins and retrieval ---------------------------------------------------


def resolve_terms(spark, sf_dir):
    collection = shared_index(spark, sf_dir).collection()
    return _six(S.resolve_terms(collection, S.any_of(spark, TERMS)), "idf")


def gather_postings(spark, sf_dir):
    collection = shared_index(spark, sf_dir).collection()
    return _six(S.gather(collection, S.any_of(spark, TERMS)), "partial").select(
        "query_id", "term", "doc_id", F.col("tf").cast("long").alias("tf"), "partial"
    )


def _search(spark, sf_dir, queries, k=K, accept=None, **options):
    return _six(shared_index(spark, sf_dir).search(queries, k, accept=accept, **options), "score")


def bm25_topk(spark, sf_dir):
    return _search(spark, sf_dir, TERMS)


def bm25_topk_scan(spark, sf_dir):
    """The same straight from the documents, without an index."""
    collection = S.Collection.from_tokens(_tokens(spark, sf_dir))
    return _six(S.search(collection, S.any_of(spark, TERMS), K), "score")


def bm25_topk_batch(spark, sf_dir):
    return _search(spark, sf_dir, batch_queries(spark, sf_dir))


def turn_queries(spark: SparkSession, sf_dir: str) -> S.Queries:
    """Every ``conversations`` turn as a query of its distinct tokens."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text")
    return S.any_of(spark, S.queries_from_text(turns, "turn_id", X.tokens("text", SIMPLE)))


def bm25_topk_blocks(spark, sf_dir):
    """Every ``conversations`` turn as a query, scored in vectorised blocks."""
    collection = shared_index(spark, sf_dir).collection()
    return _six(search_chunks(collection, turn_queries(spark, sf_dir), K, vectorize_from=0), "score")


def total_hits_blocks(spark, sf_dir):
    """Hits and the best score of every ``conversations`` turn, counted in blocks."""
    collection = shared_index(spark, sf_dir).collection()
    return _six(batch.total_hits(collection, turn_queries(spark, sf_dir), vectorize_from=0), "max_score")


def match_only_blocks(spark, sf_dir):
    """Matching documents of every ``benchmark`` item, as lists from blocks."""
    collection = shared_index(spark, sf_dir).collection()
    return batch.match_only(collection, batch_queries(spark, sf_dir), vectorize_from=0).select("query_id", "doc_id")


def bm25_all(spark, sf_dir):
    return _search(spark, sf_dir, TERMS, k=-1)


def bm25_scores(spark, sf_dir):
    collection = shared_index(spark, sf_dir).collection()
    return _six(S.scores(collection, S.any_of(spark, TERMS)), "score").select("doc_id", "score")


def bm25_whitelist(spark, sf_dir):
    index = shared_index(spark, sf_dir)
    allowed = S.impacts(index.collection(), WHITELIST, index.stats()["n_postings"])
    return _six(S.search_impacts(allowed, S.any_of(spark, TERMS), K), "score")


def bm25_accept_docs(spark, sf_dir):
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    return _search(spark, sf_dir, TERMS, accept=english)


def bm25_repeat_terms(spark, sf_dir):
    return _search(spark, sf_dir, REPEATED)


def bm25_distinct_terms(spark, sf_dir):
    return _search(spark, sf_dir, S.any_of(spark, REPEATED).distinct_terms())


def bm25_boost(spark, sf_dir):
    return _search(spark, sf_dir, S.any_of(spark, REPEATED).boosted(BOOST))


def bm25_small_boost(spark, sf_dir):
    """Tiny weights rank as large ones do."""
    found = shared_index(spark, sf_dir).search(S.any_of(spark, TERMS).boosted(SMALL_BOOST), K)
    return found.withColumn("score", F.round(F.col("score") * 1e7, 6))


def bm25_no_norms(spark, sf_dir):
    return _search(spark, sf_dir, TERMS, use_norms=False)


def total_hits(spark, sf_dir):
    queries = S.any_of(spark, SEVERAL)
    collection = shared_index(spark, sf_dir).collection()
    return _six(batch.total_hits(collection, queries), "max_score")


def candidate_size(spark, sf_dir):
    return S.candidate_size(shared_index(spark, sf_dir).collection(), S.any_of(spark, {**SEVERAL, 5: REPEATED}))


def match_only(spark, sf_dir):
    return batch.match_only(shared_index(spark, sf_dir).collection(), S.any_of(spark, SEVERAL)).select("query_id", "doc_id")


def explain_topk(spark, sf_dir):
    collection = shared_index(spark, sf_dir).collection()
    queries = batch_queries(spark, sf_dir)
    rows = S.explain(collection, queries, S.search(collection, queries, K))
    rows = rows.withColumns({c: F.col(c).cast("long") for c in ("tf", "dl")}).drop("boost")
    return _six(rows, "idf", "norm", "partial")


def score_all_docs(spark, sf_dir):
    return _six(S.score_all(shared_index(spark, sf_dir).collection(), S.any_of(spark, TERMS)), "score")


def compare_rankings(spark, sf_dir):
    index = shared_index(spark, sf_dir)
    queries = batch_queries(spark, sf_dir)
    both = compare.compare_hits(index.search(queries, K), index.search(queries, K, quantize=False))
    both = both.drop("score_delta").na.fill(0, ["left_rank", "right_rank", "rank_delta"])
    return _six(both, "left_score", "right_score")


# ---- nearest points ---------------------------------------------------------


def geo_distance(spark, sf_dir):
    return _six(nearest.distances(_points(spark, sf_dir), *POINT), "dist")


def geo_nearest(spark, sf_dir):
    scored = nearest.distances(_points(spark, sf_dir), *POINT)
    ranked = with_positions(scored, [F.col("dist"), F.col("doc_id")], "rank")
    return _six(ranked, "dist").select((F.col("rank") + 1).alias("rank"), "doc_id", "dist")


def geo_topk(spark, sf_dir):
    return _six(nearest.nearest(_points(spark, sf_dir), *POINT, k=K), "dist")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_limit, csv_roundtrip, csv_split, csv_numbered, abstracts_roundtrip, abstracts_carry, xml_abstracts, extract_title_desc, strip_title, filter_min_length,
        assign_doc_ids, segment_offsets, tokenize, tokenize_stopwords, tokenize_standard, term_freq,
        multi_field_df, doc_length, length_quantized, collection_stats, doc_freq, idf, length_norm, impacts,
        posting_lists, term_dictionary, term_offsets, index_summary, impact_sample, merge_segments,
        incremental_equals_full, stream_ingest, append_after_merge, stream_into_built_index, index_roundtrip, resolve_terms, gather_postings, bm25_topk,
        bm25_topk_scan, bm25_topk_batch, bm25_topk_blocks, total_hits_blocks, match_only_blocks, bm25_all, bm25_scores, bm25_whitelist, bm25_accept_docs,
        bm25_repeat_terms, bm25_distinct_terms, bm25_boost, bm25_small_boost, bm25_no_norms, total_hits, candidate_size,
        match_only, explain_topk, score_all_docs, compare_rankings, geo_distance, geo_nearest, geo_topk,
    )
}
