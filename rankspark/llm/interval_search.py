"""Ranked lexical search: best documents first, by range maxima over posting lists.

A task holds a block of documents and, for the words of the queries, one list of
``(document, impact)`` per word with a sparse table that answers "where is the
largest impact between these two places" in one step. A query starts with the
whole block as one interval. The sum of its words' range maxima bounds every
score inside an interval. The intervals of the highest bounds are taken first:
each is split at the document where its strongest word has its maximum, that
document is scored in full, and what is left of it on either side is bounded
anew. Intervals that cannot reach the k-th best score so far are never opened.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, map_batches, saved

# ---- fixed values ---------------------------------------------------------
# Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD_BYTES = rb"[0-9A-Za-z\x80-\xff]+"
K = 20
# ---------------------------------------------------------------------------

#: Texts of queries that are taken in one pass over the documents.
PASS_BYTES = 8 << 20
#: Documents and postings that a task holds as one block.
BLOCK_DOCS = 8_192
BLOCK_POSTINGS = 2_000_000
#: Postings of the queries that are searched side by side.
GROUP_POSTINGS = 3_000_000
#: Intervals of a query that are opened in its first round; doubled every round.
FIRST_OPENED = 4

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "query_no int, doc_id long, score long"


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased."""
    return re.findall(WORD_BYTES, text.lower())


# ---- one block -------------------------------------------------------------


class Lists:
    """Posting lists of a block, one after the other, with sparse tables of the places of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.doc = doc[order].astype(np.int32)
        self.impact = impact[order]
        lengths = np.bincount(term, minlength=n_terms)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        n = len(order)
        # Row j holds the place of the maximum of the 2**j postings from a place on. Ranges never
        # leave a list, so what a row says across the end of one is never read.
        levels = [np.arange(n, dtype=np.int32)]
        for j in range(1, int(lengths.max(initial=1)).bit_length()):
            half = 1 << (j - 1)
            left, row = levels[-1], levels[-1].copy()
            right = left[half:]
            better = self.impact[right] > self.impact[left[: n - half]]
            row[: n - half][better] = right[better]
            levels.append(row)
        self.table = np.concatenate(levels) if n else np.zeros(0, np.int32)
        self.n = n
        self.level = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
        for j in range(1, len(levels)):
            self.level[1 << j :] = j

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the largest impacts in ``[a, b)``, none of them empty; the first of equals."""
        j = self.level[b - a]
        row = j * self.n
        left = self.table[row + a]
        right = self.table[row + b - (1 << j)]
        return np.where(self.impact[right] > self.impact[left], right, left)

    def first_from(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first place in ``[a, b)`` whose document is ``doc`` or later, else ``b``: halving, all at once."""
        a, b = a.copy(), b.copy()
        for _ in range(int((b - a).max(initial=0)).bit_length()):
            middle = (a + b) >> 1
            inside = a < b
            later = self.doc[np.where(inside, middle, 0)] >= doc
            b = np.where(inside & later, middle, b)
            a = np.where(inside & ~later, middle + 1, a)
        return a


def merged(query, score, doc, k):
    """The best ``k`` of each query: highest score, then least document."""
    order = np.lexsort((doc, -score, query))
    query, score, doc = query[order], score[order], doc[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = place < k
    return query[best], score[best], doc[best]


def search_block(lists: Lists, doc_ids: np.ndarray, starts, terms, weights, best, k: int):
    """The best ``k`` documents of each query after one more block.

    ``doc_ids`` ascend. Query ``q`` has the words ``terms[starts[q]:starts[q+1]]`` and their
    weights. ``best`` is what earlier blocks gave: arrays of query, score and document.
    """
    n_queries = len(starts) - 1
    query_of = np.repeat(np.arange(n_queries), np.diff(starts))
    size = lists.start[terms + 1] - lists.start[terms]
    load = np.cumsum(np.bincount(query_of, size, n_queries))
    low = 0
    while low < n_queries:
        before = load[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(load, before + GROUP_POSTINGS, side="right")))
        mine = slice(starts[low], starts[high])
        best = _search(lists, doc_ids, query_of[mine], terms[mine], weights[mine], best, k, n_queries)
        low = high
    return best


def _limits(best, n_queries, k):
    """Score and document of each query's k-th best so far; (0, none) where there are fewer."""
    query, score, doc = best
    place = np.arange(len(query)) - np.searchsorted(query, query)
    last = place == k - 1
    limit, limit_doc = np.zeros(n_queries, np.int64), np.full(n_queries, np.iinfo(np.int64).min)
    limit[query[last]], limit_doc[query[last]] = score[last], doc[last]
    return limit, limit_doc


def _bounds(lists, count, a, b, weight):
    """Per interval the sum of its words' maxima, and the place where its strongest word has it.

    ``count`` says how many of the ranges ``[a, b)`` belong to each interval.
    """
    place = lists.maxima(a, b)
    part = lists.impact[place] * weight
    first = np.cumsum(count) - count
    bound = np.add.reduceat(part, first)
    strongest = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, first), count))
    owner = np.repeat(np.arange(len(count)), count)[strongest]
    return bound, place[strongest[np.searchsorted(owner, np.arange(len(count)))]]


def _search(lists, doc_ids, query_of, terms, weights, best, k, n_queries):
    limit, limit_doc = _limits(best, n_queries, k)
    a, b = lists.start[terms], lists.start[terms + 1]
    held = (b > a) & (weights > 0)
    a, b, weight, owner = a[held], b[held], weights[held], query_of[held]
    if not len(a):
        return best
    query, count = np.unique(owner, return_counts=True)
    low = np.zeros(len(query), np.int32)
    bound, split = _bounds(lists, count, a, b, weight)
    opened = FIRST_OPENED
    while len(query):
        # Those that can still matter: a bound over the k-th score, or equal to it with an earlier document.
        alive = (bound > limit[query]) | ((bound == limit[query]) & (bound > 0) & (doc_ids[low] < limit_doc[query]))
        order = np.lexsort((-bound, query))
        order = order[alive[order]]
        if not len(order):
            break
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        take, wait = order[rank < opened], order[rank >= opened]
        opened *= 2

        first = np.cumsum(count) - count
        at = _ranges(first[take], count[take])
        n = count[take]
        q, d = query[take], lists.doc[split[take]]
        ra, rb, rw = a[at], b[at], weight[at]
        rd = np.repeat(d, n)
        cut = lists.first_from(ra, rb, rd)
        here = (cut < rb) & (lists.doc[np.minimum(cut, lists.n - 1)] == rd)
        owner = np.repeat(np.arange(len(take)), n)
        score = np.add.reduceat(np.where(here, lists.impact[np.minimum(cut, lists.n - 1)] * rw, 0), np.cumsum(n) - n)
        counts = score > 0
        found = (q[counts], score[counts], doc_ids[d[counts]])
        # Only scores that enter the best k are merged.
        enters = (found[1] > limit[found[0]]) | ((found[1] == limit[found[0]]) & (found[2] < limit_doc[found[0]]))
        if enters.any():
            best = merged(*(np.concatenate([x, y[enters]]) for x, y in zip(best, found)), k)
            limit, limit_doc = _limits(best, n_queries, k)

        # What is left on either side, without the words that do not occur there.
        sides = []
        for sa, sb, lo in ((ra, cut, low[take]), (cut + here, rb, d + 1)):
            full = sb > sa
            if full.any():
                which, size = np.unique(owner[full], return_counts=True)
                sa, sb, sw = sa[full], sb[full], rw[full]
                sides.append((q[which], size, lo[which], sa, sb, sw, *_bounds(lists, size, sa, sb, sw)))
        keep = _ranges(first[wait], count[wait])
        old = (query[wait], count[wait], low[wait], a[keep], b[keep], weight[keep], bound[wait], split[wait])
        query, count, low, a, b, weight, bound, split = (np.concatenate(x) for x in zip(old, *sides))
    return best


def _ranges(start, count):
    """``start[i], start[i]+1, …`` for ``count[i]`` places, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


# ---- over all documents ------------------------------------------------------


def _word_counts(documents: DataFrame, vocabulary) -> DataFrame:
    """Per document with a word: how many words, and which of the vocabulary how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch, texts in chunks(batches, "text"):
            sizes, terms, tfs = [], [], []
            for text in texts:
                found = words(text)
                counted = Counter(word for word in found if word in known)
                sizes.append(len(found))
                terms.append([known[word] for word in counted])
                tfs.append(list(counted.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return map_batches(documents, POSTINGS, count).where("n > 0")


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _best_of_tasks(counted: DataFrame, queries, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``(query_no, doc_id, score)``: the best ``k`` of every task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, weights, n_terms = queries.value
        best = (np.zeros(0, np.int64),) * 3
        held, docs, postings = [], 0, 0

        def search():
            ids = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            term = np.concatenate([h[3] for h in held])
            tf = np.concatenate([h[4] for h in held])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = 75 + (25 * sizes * n_docs) // n_words
            impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * np.repeat(m, lengths))
            lists = Lists(term, np.repeat(place, lengths), impact, n_terms)
            return search_block(lists, ids[order], starts, terms, weights, best, k)

        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                lengths = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                if held and (docs + batch.num_rows > BLOCK_DOCS or postings + lengths.sum() > BLOCK_POSTINGS):
                    best = search()
                    held, docs, postings = [], 0, 0
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((ids, sizes, lengths, _flat(batch, "terms"), _flat(batch, "tfs")))
                docs, postings = docs + batch.num_rows, postings + int(lengths.sum())
        if held:
            best = search()
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0], pa.int32()), pa.array(best[2], pa.int64()), pa.array(best[1], pa.int64())],
            names=["query_no", "doc_id", "score"],
        )

    return counted.mapInArrow(find, FOUND)


def _passes(items: DataFrame) -> Iterator[list]:
    """Rows of ``(item_id, text)``, so many at a time as hold ``PASS_BYTES`` of text (or one)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        width = len((row["text"] or "").encode())
        if held and size + width > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += width
    if held:
        yield held


#: Stands for a missing doc_id inside tasks: such documents come last among equal scores.
NO_ID = np.iinfo(np.int64).max


def ranked_search(
    documents: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(item_id, rank int, doc_id, score)``: the ``k`` best documents of every item.

    Terms, weights, impacts and scores are integers as in the contract of ``op12``.
    The documents' counts of the items' words are written once per pass; a pass
    holds ``PASS_BYTES`` of item texts, which bounds what is broadcast and what
    reaches the driver. Tasks pass on ``k`` documents per item.

    *Nulls*: a null text has no words. A document without id counts and may be
    found (its id is null), last among equal scores; 2**63 - 1 is kept for it. An item's null id is handed
    through. *Empty and wordless* documents count nowhere; such items find
    nothing. *Very long* texts are read whole. *Ties*: the lesser id. *Repeated
    rows*: each document and each item row is one of its own. *Empty tables*: no
    rows. *Other columns* are not read, whatever their names.
    """
    spark = documents.sparkSession
    schema = T.StructType(
        [
            T.StructField("item_id", items.schema[item_id].dataType),
            *[T.StructField(n, t) for n, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))],
        ]
    )
    read = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.col(text).alias("text"))
    found = []
    for rows in _passes(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))):
        counts = [Counter(words((row["text"] or "").encode())) for row in rows]
        vocabulary = {word: no for no, word in enumerate(dict.fromkeys(word for c in counts for word in c))}
        if not vocabulary:
            continue
        known = spark.sparkContext.broadcast(vocabulary)
        counted = saved(_word_counts(read, known), "word_counts")
        known.unpersist()
        n_docs, n_words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # At most one row per word of this pass.
        df = np.zeros(len(vocabulary), np.int64)
        frequencies = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        for row in frequencies.toLocalIterator():
            df[row["term"]] = row["df"]
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df]
        starts = np.cumsum([0] + [len(c) for c in counts])
        terms = np.array([vocabulary[word] for c in counts for word in c], np.int64)
        weights = np.array([times * weight[vocabulary[word]] for c in counts for word, times in c.items()], np.int64)
        shared = spark.sparkContext.broadcast((starts, terms, weights, len(vocabulary)))
        best = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc("doc_id"))
        ranked = _best_of_tasks(counted, shared, n_docs, n_words, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        # As many rows as this pass has items.
        names = spark.createDataFrame(
            [(no, row["item_id"]) for no, row in enumerate(rows)], T.StructType([T.StructField("query_no", T.IntegerType()), schema[0]])
        )
        ranked = ranked.join(F.broadcast(names), "query_no")
        found.append(saved(ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score"), "ranked"))
        shared.unpersist()
    out = found[0] if found else spark.createDataFrame([], schema)
    for part in found[1:]:
        out = out.union(part)
    return out.select(*schema.names)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, {_WORDS} AS t FROM documents),
n AS (SELECT no, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
tf AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(t) AS term FROM d) GROUP BY no, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
       FROM tf, total GROUP BY term),
i AS (SELECT row_number() OVER () AS query_no, item_id, {_WORDS} AS t FROM benchmark),
q AS (SELECT query_no, item_id, term, count(*) AS times FROM (SELECT query_no, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT query_no, item_id, no, doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (no), total GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
