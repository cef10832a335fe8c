"""Source divergence audit: how far the words of sources lie apart, over a frequent-pattern tree.

Every frequent word of a language is a row: its nonzero counts in source order.
Words with the same counts are one row with a multiplicity, and rows with the
same beginning share the nodes of a tree. With ``f`` the distance of two shares
and 0 the share of an absent word, the sum over all words of ``f(p, q)`` is

    V f(0, 0) + sum [f(p, 0) - f(0, 0)] + sum [f(0, q) - f(0, 0)]
              + sum [f(p, q) - f(p, 0) - f(0, q) + f(0, 0)]

where the first two sums run over nodes and the last over pairs of a node and an
ancestor, each once with the node's multiplicity. Rows are range-partitioned in
the order of the tree, so a task walks through its part of it and holds only the
path from the root; sums over parts of a node add up.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scale import broadcast_if_small
from .common import batch_bytes, chunks, map_batches, saved

# ---- fixed values ---------------------------------------------------------
# Terms are runs of ASCII letters and of anything beyond ASCII.
TERM_BYTES = rb"[A-Za-z\x80-\xff]+"
MIN_DOCS = 10
TOP_TERMS = 10
SHARE = 1_000_000_000
SMOOTH = 2
# ---------------------------------------------------------------------------

#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 600_000
#: What a document counts beside occurrences, which stay below it within a task.
DOC = 1 << 40
#: Cells of pair sums that a task holds, or stands for, before it hands them on; cells worked on at a time.
HELD_CELLS = 20_000_000
BLOCK_CELLS = 1_000_000
#: Groups whose shares are broadcast at a time; more languages are taken in turn.
PASS_GROUPS = 500_000

COUNTS = "lang string, source string, term string, count long, docs long"
SUMS = "lang string, a int, b int, part long"


def terms(text: bytes) -> list[bytes]:
    """Terms of UTF-8 text, A-Z lower-cased."""
    return re.findall(TERM_BYTES, text.lower())


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def count_terms(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)``, added up within tasks; keys may come again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per group and term one number: occurrences, and documents DOC times.
        held: dict[tuple, dict[bytes, int]] = defaultdict(dict)

        def handed_on() -> pa.RecordBatch:
            group = pa.array(np.repeat(np.arange(len(held)), [len(found) for found in held.values()]))
            lang, source = (_strings([key[i] for key in held]).take(group) for i in (0, 1))
            both = np.fromiter(chain.from_iterable(found.values() for found in held.values()), np.int64, len(group))
            term = _strings(list(chain.from_iterable(held.values())))
            columns = [lang, source, term, pa.array(both & (DOC - 1)), pa.array(both // DOC)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

        size = 0
        for batch, texts in chunks(batches, "text"):
            for lang, source, text in zip(batch_bytes(batch, "lang"), batch_bytes(batch, "source"), texts):
                found = held[lang, source]
                size -= len(found)
                for term, n in Counter(terms(text)).items():
                    found[term] = found.get(term, 0) + (DOC + n)
                size += len(found)
                if size > HELD_WORDS:
                    yield handed_on()
                    held.clear()
                    size = 0
        yield handed_on()

    return map_batches(documents, COUNTS, count)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SHARE (count + 2) / (total + 2 V))``; decimals keep large counts exact."""
    weight = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SHARE).cast("decimal(10,0)")
    return F.call_function("div", weight, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1


# ---- the tree ----------------------------------------------------------------


def _f(p, q):
    return (p - q) * (p - q) // (p + q)


class PairSums:
    """Sums over pairs of sources of one language; ``rest[s]`` is the share of a word absent from source ``s``."""

    def __init__(self, rest: np.ndarray):
        self.rest = rest
        self.rows: dict[int, np.ndarray] = {}
        #: How many words have a source's share: what a node changes by itself depends on nothing else.
        self.alone: Counter = Counter()

    def size(self) -> int:
        return (len(self.rows) + len(self.alone)) * len(self.rest)

    def _row(self, s: int) -> np.ndarray:
        row = self.rows.get(s)
        if row is None:
            row = self.rows[s] = np.zeros(len(self.rest), np.int64)
        return row

    def close(self, sources: np.ndarray, shares: np.ndarray, depth: int, times: np.ndarray) -> None:
        """Take in the nodes of a path from ``depth`` on, with their multiplicities: each by itself and with its ancestors."""
        self.alone.update(dict(zip(zip(sources[depth:].tolist(), shares[depth:].tolist()), times.tolist())))
        q, absent = shares, self.rest[sources]
        step = max(1, BLOCK_CELLS // len(sources))
        for low in range(depth, len(sources), step):
            here = slice(low, min(low + step, len(sources)))
            p, own = shares[here, None], self.rest[sources[here], None]
            change = _f(p, q) - _f(p, absent) - _f(own, q) + _f(own, absent)
            change *= times[here.start - depth : here.stop - depth, None]
            for at, s in enumerate(sources[here].tolist(), low):
                self._row(s)[sources[:at]] += change[at - low, :at]

    def cells(self):
        """``(a, b, sum)`` of the pairs touched, ``a < b``; the sums start anew."""
        for (s, p), times in self.alone.items():
            own = self.rest[s]
            self._row(s)[:] += times * (_f(p, self.rest) - _f(own, self.rest))
        for s, row in self.rows.items():
            row[s] = 0
            other = np.flatnonzero(row)
            yield np.minimum(other, s), np.maximum(other, s), row[other]
        self.rows, self.alone = {}, Counter()


NONE = np.zeros(0, np.int64)


def walk(rows, rests) -> Iterator[tuple]:
    """Sums of a run of the tree: ``rows`` of (language, sources, counts, shares, multiplicity) in tree order.

    A node is closed when the path leaves it: only then is its multiplicity whole.
    """
    lang, sums, sources, counts, shares, times = None, None, NONE, NONE, NONE, NONE

    def leave(depth: int) -> None:
        nonlocal times
        if depth < len(sources):
            # A node has the words of its children and those that end in it.
            closed = np.cumsum(times[depth:][::-1])[::-1]
            sums.close(sources, shares, depth, closed)
            if depth:
                times[depth - 1] += closed[0]
            times = times[:depth]

    for row_lang, row_sources, row_counts, row_shares, n in rows:
        if row_lang != lang:
            leave(0)
            if sums is not None:
                yield from ((lang, *cell) for cell in sums.cells())
            lang, sums, sources, counts, times = row_lang, PairSums(rests[row_lang]), NONE, NONE, NONE
        m = min(len(sources), len(row_sources))
        differs = np.flatnonzero((sources[:m] != row_sources[:m]) | (counts[:m] != row_counts[:m]))
        same = int(differs[0]) if len(differs) else m
        leave(same)
        times = np.concatenate([times[:same], np.zeros(len(row_sources) - same, np.int64)])
        sources, counts, shares = row_sources, row_counts, row_shares
        if len(times):
            times[-1] += n
        if sums.size() > HELD_CELLS:
            yield from ((lang, *cell) for cell in sums.cells())
    leave(0)
    if sums is not None:
        yield from ((lang, *cell) for cell in sums.cells())


# ---- over all documents --------------------------------------------------------


def _pair_sums(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, part)`` from rows of ``paths(lang, path, times)``, whole languages' shares at a time."""
    spark = paths.sparkSession
    passes = max(1, math.ceil(groups.count() / PASS_GROUPS))
    parts = []
    for turn in range(passes):
        mine = F.pmod(F.xxhash64("lang"), F.lit(passes)) == turn
        # About PASS_GROUPS rows: one number per source of these languages.
        known = groups.where(mine).select("lang", "no", "rest").toArrow()
        rests = {}
        langs = np.array(known.column("lang").to_pylist(), object)
        numbers, rest = (known.column(c).to_numpy() for c in ("no", "rest"))
        for lang in set(langs):
            here = langs == lang
            rests[lang] = np.zeros(int(here.sum()), np.int64)
            rests[lang][numbers[here]] = rest[here]
        shared = spark.sparkContext.broadcast(rests)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    path = batch.column("path")
                    ends = np.cumsum(path.value_lengths().to_numpy())
                    fields = [path.flatten().field(name).to_numpy() for name in ("no", "count", "share")]
                    for lang, end, start, times in zip(
                        batch.column("lang").to_pylist(), ends, np.concatenate([[0], ends[:-1]]), batch.column("times").to_pylist()
                    ):
                        yield (lang, *(f[start:end] for f in fields), times)

            for lang, a, b, part in walk(rows(), shared.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(part, pa.int64())],
                    names=["lang", "a", "b", "part"],
                )

        ordered = paths.where(mine).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
        parts.append(map_batches(ordered, SUMS, add))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))


def divergence(documents: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` as in the contract of ``op13``.

    Words are counted inside tasks and added up twice: by language, source and
    word, and by language and word (one cell per source). Only words in
    ``min_docs`` documents go on. The result of a language holds the square of its
    number of sources, so its list of sources is held by a task; words and
    documents are not.

    *Nulls*: ``''``. *Empty texts*: their group occurs, without terms. *Very long*
    texts are read whole. *Ties*: the lesser item in bytes. *Repeated rows*: each
    is a document. *Empty table*: no rows. *Other columns* are not read, whatever
    their names.
    """
    read = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = count_terms(read).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    words = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("cells")
    )
    kept = saved(words.where(F.col("docs") >= min_docs).drop("docs"), "kept_words")
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("whole"))

    cells = kept.select("lang", "term", "total", F.inline("cells"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = read.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(broadcast_if_small(whole), "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no"),
        *[F.coalesce(c, zero).alias(c) for c in ("n", "kept", "whole")],
    )
    # A language without kept terms has no shares.
    groups = groups.withColumn("rest", F.when(F.col("kept") > 0, share(zero, F.col("n"), F.col("kept"))))
    groups = saved(groups, "groups")

    shares = cells.join(broadcast_if_small(groups), ["lang", "source"])
    shares = shares.withColumn("share", share(F.col("count"), F.col("n"), F.col("kept")))

    path = F.sort_array(F.collect_list(F.struct("no", "count", "share"))).alias("path")
    paths = shares.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    sums = _pair_sums(saved(paths, "paths"), groups.where("kept > 0"))
    # The result itself: every pair of sources of a language.
    a = groups.select("lang", F.col("no").alias("a"), F.col("source").alias("source"), F.col("rest").alias("rest_a"), "kept")
    b = groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"), F.col("rest").alias("rest_b"))
    absent = F.coalesce(F.col("kept") * distance(F.col("rest_a"), F.col("rest_b")), zero)
    pairs = broadcast_if_small(a).join(b, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", "item", (absent + F.coalesce("part", zero)).alias("value"))
    pairs = pairs.union(pairs.select("lang", "item", "source", "value"))

    q = share(F.col("total"), F.col("whole"), F.col("kept"))
    far = shares.withColumn("q", q).where(F.col("share") > F.col("q"))
    far = far.select("lang", "source", F.col("term").alias("item"), distance(F.col("share"), F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [rows.withColumn("rank", F.row_number().over(best)) for rows in (pairs, far)]
    named = [
        rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
        for rows, part in zip((ranked[0], ranked[1].where(F.col("rank") <= top)), ("pair", "term"))
    ]
    return named[0].union(named[1])


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
w AS (SELECT no, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT no) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c
          FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM every GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, source, term, c, CAST(1 + ({SHARE}::HUGEINT * (c + {SMOOTH})) // (n + {SMOOTH} * v) AS BIGINT) AS p
      FROM every JOIN n USING (lang, source) JOIN v USING (lang)),
l AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM every GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + ({SHARE}::HUGEINT * (c + {SMOOTH})) // (sum(c) OVER (PARTITION BY lang) + {SMOOTH} * v) AS BIGINT) AS q
      FROM l JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
words AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
          FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM words) WHERE rank <= {TOP_TERMS}
"""
