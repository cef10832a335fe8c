"""Any-of-these-terms retrieval: resolve, gather, sum by document, rank.

All operators work on a :class:`Collection` and on a table of queries, one
query or millions, and return DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bm25
from . import postings as P
from .scale import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    HEAVY_SLOTS,
    WINDOW_K,
    broadcast_if_small,
    cut_lineage,
    join_term_stats,
    measured_small,
    with_positions,
)

# Parquet checks an IN list value by value against row-group statistics only up
# to this length, so longer literal lists are passed as several short ones.
PUSHED_IN_LENGTH = 10
PUSHED_TERMS = 200

# Postings of one term that a task joins with queries too many to broadcast. A
# larger corpus raises it, so that no more than HEAVY_SLOTS terms are split.
SPLIT_POSTINGS = 1_000_000

# A score is a whole number of ticks of its query's unit. Sums of up to 2**53
# ticks are exact, so their order does not matter: not even a score that falls
# on the border of two ranking keys depends on how rows were dealt out.
TICKS = float(1 << 50)


# ---- queries ------------------------------------------------------------


@dataclass(frozen=True)
class Queries:
    """``frame(query_id, term, boost)``, one row per occurrence of a term.

    ``literal`` holds the distinct terms and ``packed`` the weights when they
    are known on the driver. A null term stands for a query without terms.
    """

    frame: DataFrame
    literal: tuple[str, ...] | None = None
    small: bool = False
    packed: DataFrame | None = None

    @property
    def ids(self) -> DataFrame:
        return self.frame.select("query_id").distinct()

    @property
    def occurrences(self) -> DataFrame:
        return self.frame.filter(F.col("term").isNotNull())

    def weights(self) -> DataFrame:
        """``(query_id, term, boost)``: a repeated term counts once per occurrence."""
        if self.packed is not None:
            return self.packed
        return self.occurrences.groupBy("query_id", "term").agg(F.sum("boost").alias("boost"))

    def terms(self) -> DataFrame:
        return self.occurrences.select("term").distinct()

    def distinct_terms(self) -> Queries:
        """The same queries with every term counted once, at its largest boost."""
        return replace(self, frame=self.frame.groupBy("query_id", "term").agg(F.max("boost").alias("boost")), packed=None)

    def boosted(self, factor: float) -> Queries:
        frame = self.frame.withColumn("boost", F.col("boost") * F.lit(float(factor)))
        return replace(self, frame=frame, packed=None)

    def small_side(self, df: DataFrame) -> DataFrame:
        """Mark a per-query-term side for broadcast when the queries were measured small."""
        return F.broadcast(df) if self.small else df


QUERY_COLUMNS = ["query_id", "term", "boost"]
QUERY_TYPES = [pa.int64(), pa.string(), pa.float64()]


def _local_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    columns = zip(*rows) if rows else ([], [], [])
    arrays = [pa.array(column, kind) for column, kind in zip(columns, QUERY_TYPES)]
    return spark.createDataFrame(pa.table(arrays, names=QUERY_COLUMNS))


def _check_terms(terms: object) -> list[str]:
    if isinstance(terms, (str, bytes, Mapping)) or not isinstance(terms, Iterable):
        raise ValueError(f"a query is a list of terms, any of which may match; got {type(terms).__name__}")
    terms = list(terms)
    for term in terms:
        if not isinstance(term, str):
            raise ValueError(f"a query holds plain terms only; got {type(term).__name__}")
    return terms


def any_of(spark: SparkSession, queries: object, boost: float = 1.0) -> Queries:
    """Take in OR queries over exact terms (terms are not analyzed).

    ``queries`` is a list of terms (query 0), a mapping from query id to a list
    of terms, or a DataFrame ``(query_id, term[, boost])``; a null boost is 1. Anything else, such
    as required or excluded clauses, raises ``ValueError``.
    """
    if isinstance(queries, Queries):
        return queries if boost == 1.0 else queries.boosted(boost)
    if isinstance(queries, DataFrame):
        missing = {"query_id", "term"} - set(queries.columns)
        if missing:
            raise ValueError(f"query table lacks {sorted(missing)}")
        given = F.coalesce(F.col("boost").cast("double"), F.lit(1.0)) if "boost" in queries.columns else F.lit(1.0)
        frame = queries.select("query_id", "term", (given * F.lit(float(boost))).alias("boost"))
        return Queries(frame, None, measured_small(frame))
    by_id = queries if isinstance(queries, Mapping) else {0: queries}
    rows, literal = [], set()
    for query_id, terms in by_id.items():
        if not isinstance(query_id, int):
            raise ValueError("query ids in a mapping are integers")
        terms = _check_terms(terms)
        literal.update(terms)
        rows.extend((query_id, term, float(boost)) for term in terms or [None])
    packed = {}
    for query_id, term, weight in rows:
        if term is not None:
            packed[query_id, term] = packed.get((query_id, term), 0.0) + weight
    size = sum(len(term or "") * 4 + 16 for _, term, _ in rows)
    return Queries(
        _local_frame(spark, rows),
        tuple(sorted(literal)),
        len(rows) <= BROADCAST_ROWS and size <= BROADCAST_BYTES,
        _local_frame(spark, [(*key, weight) for key, weight in packed.items()]),
    )


def queries_from_text(df: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """``(query_id, term)`` from a table of query texts, one row per distinct token."""
    return df.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(tokens)).alias("term"))


def term_filter(literal: tuple[str, ...]) -> Column:
    """A predicate Parquet can check against its statistics."""
    if len(literal) > PUSHED_TERMS:
        return F.col("term").isin(*literal)
    parts = [literal[i : i + PUSHED_IN_LENGTH] for i in range(0, len(literal), PUSHED_IN_LENGTH)]
    return reduce(lambda a, b: a | b, [F.col("term").isin(*p) for p in parts], F.lit(False))


# ---- collections --------------------------------------------------------


@dataclass(frozen=True)
class Collection:
    """One field of a corpus, ready to be searched.

    ``postings(doc_id, term, tf, dl)``, ``lengths(doc_id, dl)`` for all
    documents, ``dictionary(term, df)`` or ``None`` to count df from the
    postings of the query terms. ``n_docs`` and ``avgdl`` are columns: literals
    of a stored index, scalar subqueries of a lazy one. A lazy one keeps
    ``tokenized`` to count the terms of literal queries only; a stored one has
    ``bounds(term, max_tf, min_dl)`` of what a posting can weigh.
    """

    postings: DataFrame
    lengths: DataFrame
    n_docs: Column
    avgdl: Column
    dictionary: DataFrame | None = None
    tokenized: DataFrame | None = None
    bounds: DataFrame | None = None
    k1: float = bm25.K1
    b: float = bm25.B
    quantize: bool = True
    use_norms: bool = True

    @classmethod
    def from_documents(
        cls, documents: DataFrame, analyzer: str = "standard", stop_words: Iterable[str] = (), **options
    ) -> Collection:
        """A lazy collection straight from ``documents(doc_id, text)``."""
        return cls.from_tokens(P.tokenize(documents, analyzer, stop_words), **options)

    @classmethod
    def from_tokens(cls, tokenized: DataFrame, **options) -> Collection:
        lengths = P.doc_lengths(tokenized)
        stats = P.collection_stats(lengths)
        return cls(
            postings=P.build_postings(tokenized),
            lengths=lengths,
            n_docs=stats.select("n_docs").scalar(),
            avgdl=stats.select("avgdl").scalar(),
            tokenized=tokenized,
            **options,
        )

    def with_options(self, **options) -> Collection:
        """Another ``k1``, ``b``, ``quantize`` or ``use_norms``, without rebuilding anything."""
        return replace(self, **options)

    def norm(self) -> Column:
        length = P.norm_length(F.col("dl"), self.quantize, self.use_norms)
        return bm25.length_norm(length, self.avgdl, self.k1, self.b)

    def restricted(self, queries: Queries, accept: DataFrame | None = None) -> DataFrame:
        """Postings that can matter to the queries, filtered at the scan where terms are literal."""
        out = self._literal_postings(queries)
        if accept is None:
            return out
        if queries.literal is None and queries.small:
            # Few postings are left for the join with the accepted documents.
            out = out.join(F.broadcast(queries.terms()), "term", "left_semi")
        return out.join(accept.select("doc_id"), "doc_id", "left_semi")

    def _literal_postings(self, queries: Queries) -> DataFrame:
        if queries.literal is None:
            return self.postings
        if self.tokenized is not None:
            return P.build_postings(self.tokenized, only=queries.literal)
        return self.postings.filter(term_filter(queries.literal))

    def resolve(self, queries: Queries) -> DataFrame:
        """``(term, df, idf)`` of the query terms that exist."""
        stored = self.dictionary is not None
        if queries.literal is None:
            source = self.dictionary if stored else self.postings
            found = source.join(queries.small_side(queries.terms()), "term", "left_semi")
        else:
            found = self.dictionary.filter(term_filter(queries.literal)) if stored else self._literal_postings(queries)
        if not stored:
            found = P.doc_freq(found)
        return found.select("term", "df", bm25.idf(F.col("df"), self.n_docs).alias("idf"))


# ---- operators ----------------------------------------------------------


def split_counts(terms: DataFrame) -> tuple[DataFrame, int]:
    """``(_hash, _splits)`` of the frequent ones of ``terms(term, df)``, and up to how many postings a term stays whole.

    By hash, so that long terms do not matter; at most ``HEAVY_SLOTS`` rows.
    """
    hashed = cut_lineage(terms.groupBy(F.xxhash64("term").alias("_hash")).agg(F.max("df").alias("df")))
    whole = max(SPLIT_POSTINGS, (hashed.agg(F.sum("df")).first()[0] or 0) // HEAVY_SLOTS)
    return hashed.where(F.col("df") > whole).select("_hash", F.ceil(F.col("df") / whole).alias("_splits")), whole


def _with_query(postings: DataFrame, weights: DataFrame, queries: Queries) -> DataFrame:
    """Give every posting to every query that holds its term; ``weights`` has the terms' ``df``."""
    if queries.small:
        return postings.join(F.broadcast(weights), "term")
    # Too many queries to broadcast: shuffle both by term, frequent ones split by
    # document; a query's row is copied as often as its own term is split.
    splits = F.broadcast(split_counts(weights.select("term", "df").distinct())[0])
    n = F.coalesce(F.col("_splits"), F.lit(1))

    def known(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_hash", F.xxhash64("term")).join(splits, "_hash", "left")

    salted = known(weights).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    spread = known(postings).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), n))
    return spread.drop("_hash", "_splits").join(salted.drop("_hash", "_splits"), ["term", "_salt"]).drop("_salt")


def with_units(resolved: DataFrame) -> DataFrame:
    """Add each query's ``unit``, a power of two that no sum of its weights exceeds."""
    query = Window.partitionBy("query_id")
    largest = F.max(F.abs(F.col("boost") * F.col("idf"))).over(query)
    power = F.ceil(F.log2(largest)) + F.ceil(F.log2(F.count(F.lit(1)).over(query).cast("double")))
    return resolved.withColumn("unit", F.when(largest > 0, F.pow(F.lit(2.0), power)).otherwise(1.0))


def resolve_terms(collection: Collection, queries: Queries) -> DataFrame:
    """``(query_id, term, boost, df, idf)``: query terms found in the dictionary; others drop out."""
    return queries.weights().join(queries.small_side(collection.resolve(queries)), "term")


def resolve_local(collection: Collection, queries: Queries) -> pa.Table:
    """Query terms with ``df``, ``idf``, ``weight`` and ``unit``, for queries that were measured small: at most one row per query and term."""
    return weighed(resolve_terms(collection, queries).toArrow())


def weighed(table: pa.Table) -> pa.Table:
    """Resolved query terms with ``weight`` and ``unit``."""
    weight = table["boost"].to_numpy() * table["idf"].to_numpy()
    ids = table["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    n_queries = int(ids.max(initial=-1)) + 1
    largest, count = np.zeros(n_queries), np.bincount(ids, minlength=n_queries)
    np.maximum.at(largest, ids, np.abs(weight))
    with np.errstate(divide="ignore"):
        unit = np.where(largest > 0, np.exp2(np.ceil(np.log2(largest)) + np.ceil(np.log2(count))), 1.0)
    return table.append_column("weight", pa.array(weight)).append_column("unit", pa.array(unit[ids], pa.float64()))


def gather(
    collection: Collection, queries: Queries, accept: DataFrame | None = None, resolved: DataFrame | None = None
) -> DataFrame:
    """Every (query, posting) pair with all parts of its score."""
    norm = collection.norm()
    # Per posting, so computed before postings are handed out to queries.
    weight = bm25.saturation(F.col("tf"), norm, collection.k1)
    rows = collection.restricted(queries, accept).select(
        "doc_id", "term", "tf", "dl", norm.alias("norm"), weight.alias("weight")
    )
    if resolved is None and queries.small and collection.dictionary is not None:
        resolved = collection.postings.sparkSession.createDataFrame(resolve_local(collection, queries).drop_columns(["weight"]))
    elif resolved is None:
        resolved = resolve_terms(collection, queries)
    if "unit" not in resolved.columns:
        resolved = with_units(resolved)
    paired = _with_query(rows, resolved, queries)
    return paired.withColumn("partial", F.col("boost") * F.col("idf") * F.col("weight"))


def scores(
    collection: Collection, queries: Queries, accept: DataFrame | None = None, resolved: DataFrame | None = None
) -> DataFrame:
    """``(query_id, doc_id, score, key)`` of all matching documents; ``key`` is what ranking compares.

    On a stored index every document lives in one bucket, so this sum needs no
    shuffle.
    """
    return sum_partials(gather(collection, queries, accept, resolved))


def sum_partials(gathered: DataFrame) -> DataFrame:
    ticks = F.rint(F.col("partial") / F.col("unit") * TICKS).cast("long")
    # A match counts, however little its term weighs beside others.
    ticks = F.when(F.col("partial") > 0, F.greatest(ticks, F.lit(1))).otherwise(ticks)
    summed = gathered.groupBy("query_id", "doc_id").agg(F.sum(ticks).alias("_ticks"), F.max("unit").alias("_unit"))
    part = F.col("_ticks") / F.lit(TICKS)
    return summed.select("query_id", "doc_id", (part * F.col("_unit")).alias("score"), bm25.rank_key(part).alias("key"))


def rank(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query, ties by document id; all with a positive score if ``k < 0``."""
    columns = ["query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score"]
    keyed = scored if "key" in scored.columns else scored.withColumn("key", bm25.rank_key(F.col("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), F.asc("doc_id"))
    if 0 <= k <= WINDOW_K:
        return keyed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*columns)
    if k < 0:
        keyed = keyed.filter(F.col("score") > 0)
    placed = with_positions(keyed, [F.asc("query_id"), F.desc("key"), F.asc("doc_id")], "_pos")
    first = broadcast_if_small(placed.groupBy("query_id").agg(F.min("_pos").alias("_first")))
    placed = placed.join(first, "query_id").withColumn("rank", F.col("_pos") - F.col("_first") + 1)
    return (placed.filter(F.col("rank") <= k) if k > 0 else placed).select(*columns)


def search(
    collection: Collection,
    queries: Queries,
    k: int,
    accept: DataFrame | None = None,
    resolved: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``."""
    return rank(scores(collection, queries, accept, resolved), k)


def totals(scored: DataFrame, queries: Queries) -> DataFrame:
    """``(query_id, total_hits, max_score)``, with a row for queries that match nothing."""
    found = scored.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_hits"), F.max("score").alias("max_score")
    )
    return with_all_queries(found, queries)


def with_all_queries(found: DataFrame, queries: Queries) -> DataFrame:
    """``found(query_id, total_hits, max_score)`` and a row for every other query."""
    return queries.ids.join(found, "query_id", "left").select(
        "query_id", F.coalesce("total_hits", F.lit(0)).alias("total_hits"), "max_score"
    )


def candidate_size(collection: Collection, queries: Queries) -> DataFrame:
    """``(query_id, candidates)``: postings a query has to read, one list per occurrence of a term."""
    resolved = queries.small_side(collection.resolve(queries).select("term", "df"))
    found = queries.occurrences.join(resolved, "term").groupBy("query_id").agg(F.sum("df").alias("candidates"))
    return queries.ids.join(found, "query_id", "left").select(
        "query_id", F.coalesce("candidates", F.lit(0)).alias("candidates")
    )


def match_only(collection: Collection, queries: Queries, accept: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id)`` of matching documents, unscored."""
    if queries.small:
        weights = queries.weights().select("query_id", "term")
    else:
        weights = resolve_terms(collection, queries).select("query_id", "term", "df")
    return _with_query(collection.restricted(queries, accept), weights, queries).select("query_id", "doc_id").distinct()


def explain(collection: Collection, queries: Queries, hits: DataFrame) -> DataFrame:
    """One row per hit and matching term with every factor of the partial score."""
    # Stored first, so that the ranking does not run again to be measured and joined.
    wanted = broadcast_if_small(cut_lineage(hits.select("query_id", "doc_id")))
    # Postings of other documents are left out before they are paired with queries.
    return gather(collection, queries, accept=wanted.select("doc_id").distinct()).join(wanted, ["query_id", "doc_id"], "left_semi").select(
        "query_id", "doc_id", "term", "tf", "df", "idf", "dl", "norm", "boost", "partial"
    )


def score_all(collection: Collection, queries: Queries) -> DataFrame:
    """``(doc_id, score)`` for every document of the corpus under one query, 0 where nothing matches."""
    if queries.ids.limit(2).count() > 1:
        raise ValueError("score_all takes one query at a time")
    # Merged, as both sides of a stored index lie in the same buckets.
    found = scores(collection, queries).select("doc_id", "score").hint("merge")
    return collection.lengths.select("doc_id").join(found, "doc_id", "left").na.fill(0.0, ["score"])


def impacts(
    collection: Collection,
    vocabulary: DataFrame | Iterable[str] | None = None,
    n_postings: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``(term, doc_id, partial)`` of the whole vocabulary, or of a whitelist.

    Collection statistics, df and lengths come from the whole corpus either way.
    """
    rows = collection.postings
    if not isinstance(vocabulary, DataFrame):
        rows = P.keep_terms(rows, vocabulary)
    # A whitelist table restricts the dictionary, where every term is one row;
    # postings of other terms then find no partner.
    dictionary = collection.dictionary if collection.dictionary is not None else P.doc_freq(rows)
    dictionary = P.keep_terms(dictionary, vocabulary)
    dictionary = dictionary.select("term", "df", bm25.idf(F.col("df"), collection.n_docs).alias("idf"))
    joined = join_term_stats(rows, dictionary, ["term"], n_postings, buckets)
    partial = bm25.partial_score(F.col("tf"), collection.norm(), F.col("idf"), collection.k1)
    return joined.select("term", "doc_id", partial.alias("partial"))


def search_impacts(
    stored: DataFrame, queries: Queries, k: int, accept: DataFrame | None = None
) -> DataFrame:
    """Search over precomputed partial scores ``stored(term, doc_id, partial)``."""
    return rank(impact_scores(stored, queries, accept), k)


def impact_scores(stored: DataFrame, queries: Queries, accept: DataFrame | None = None) -> DataFrame:
    out = stored.filter(term_filter(queries.literal)) if queries.literal is not None else stored
    if accept is not None:
        out = out.join(accept.select("doc_id"), "doc_id", "left_semi")
    weights = queries.weights()
    # Decimals keep these sums exact whatever the idf; boosts count relative to the query's largest.
    weights = weights.withColumn("unit", F.max(F.abs("boost")).over(Window.partitionBy("query_id")))
    if not queries.small:
        weights = weights.join(P.doc_freq(out.join(queries.terms(), "term", "left_semi")), "term")
    gathered = _with_query(out, weights, queries)
    part = F.coalesce(F.col("boost") / F.nullif("unit", F.lit(0.0)), F.lit(0.0)) * F.col("partial")
    summed = gathered.groupBy("query_id", "doc_id").agg(F.sum(part.cast("decimal(28,20)")).cast("double").alias("_sum"), F.max("unit").alias("_unit"))
    return summed.select("query_id", "doc_id", (F.col("_sum") * F.col("_unit")).alias("score"), bm25.rank_key(F.col("_sum")).alias("key"))
