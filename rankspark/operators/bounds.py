"""Top-k of one query without reading all postings of its frequent terms.

A stored index keeps, per term, the most a posting can weigh. The rare terms are
scored first; the k-th best of these partial scores is a threshold that the
final k-th score cannot fall below. If all frequent terms together weigh less,
a document without a rare term cannot enter the ranking, and one with rare terms
only if what it has, and the most the others can add, reach the threshold. For
these few documents the query is scored in full: their ids reach the scan, where
the row groups and pages of the frequent terms that hold none of them are left
out, postings of a term being sorted by document.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bm25
from . import search as S
from .scale import cut_lineage

#: From this many postings of frequent terms on, a second look at the rare ones pays.
SKIP_FROM = 5_000_000
#: The rare terms are those that hold no more than this share of the query's postings.
RARE_SHARE = 0.125
#: Documents that are named in the scan; more are joined.
PUSHED_DOCS = 200
#: Covers the rounding of sums.
MARGIN = 1e-6


def _most(collection: S.Collection, terms: dict[str, float]) -> float:
    """The most that ``terms`` (with their weights) can add to a document."""
    norm = collection.norm()
    most = collection.bounds.withColumnRenamed("min_dl", "dl").filter(S.term_filter(tuple(terms)))
    rows = most.select("term", bm25.saturation(F.col("max_tf"), norm, collection.k1).alias("most")).collect()
    return sum(terms[r["term"]] * r["most"] for r in rows)


def _rare(table: pa.Table) -> set[str]:
    """The rarest terms that together hold a small share of the postings."""
    df = dict(zip(table["term"].to_pylist(), table["df"].to_pylist()))
    left, rare = RARE_SHARE * sum(df.values()), set()
    for term in sorted(df, key=lambda t: (df[t], t)):
        left -= df[term]
        if left < 0:
            break
        rare.add(term)
    return rare


def candidates(
    collection: S.Collection, queries: S.Queries, table: pa.Table, k: int, accept: DataFrame | None, skip_from: int
) -> DataFrame | None:
    """``(doc_id)`` of the only documents that can be among the best ``k``; None if that is not worth it or not known."""
    spark = collection.postings.sparkSession
    if collection.bounds is None or len(set(table["query_id"].to_pylist())) != 1 or pc.min(table["weight"]).as_py() <= 0:
        return None
    rare = _rare(table)
    is_rare = pa.array([term in rare for term in table["term"].to_pylist()])
    frequent = table.filter(pc.invert(is_rare))
    if not rare or (pc.sum(frequent["df"]).as_py() or 0) < skip_from:
        return None
    most = _most(collection, dict(zip(frequent["term"].to_pylist(), frequent["weight"].to_pylist())))
    some = S.Queries(queries.frame.filter(F.col("term").isin(sorted(rare))), tuple(sorted(rare)), True)
    resolved = spark.createDataFrame(table.filter(is_rare).drop_columns(["weight"]))
    partial = cut_lineage(S.scores(collection, some, accept, resolved))
    last = S.rank(partial, k).filter(F.col("rank") == k).first()
    if last is None or most * (1 + MARGIN) >= last["score"]:
        return None
    return partial.filter(F.col("score") + most * (1 + MARGIN) >= last["score"] * (1 - MARGIN)).select("doc_id")


def search_literal(
    collection: S.Collection, queries: S.Queries, k: int, accept: DataFrame | None = None, skip_from: int | None = None
) -> DataFrame:
    """``(query_id, rank, doc_id, score)``, the same result as :func:`search`, for queries given term by term."""
    if not queries.small or not 0 < k <= S.WINDOW_K:
        return S.search(collection, queries, k, accept)
    table = S.resolve_local(collection, queries)
    resolved = collection.postings.sparkSession.createDataFrame(table.drop_columns(["weight"]))
    if table.num_rows:
        found = candidates(collection, queries, table, k, accept, SKIP_FROM if skip_from is None else skip_from)
        if found is not None:
            ids = [r["doc_id"] for r in found.limit(PUSHED_DOCS + 1).collect()]
            if len(ids) <= PUSHED_DOCS:
                some = [F.col("doc_id").isin(ids[i : i + S.PUSHED_IN_LENGTH]) for i in range(0, len(ids), S.PUSHED_IN_LENGTH)]
                collection = collection.with_options(postings=collection.postings.filter(reduce(lambda a, b: a | b, some)))
            else:
                collection = collection.with_options(postings=collection.postings.join(found, "doc_id", "left_semi"))
    return S.search(collection, queries, k, accept, resolved)
