"""A stored index: two bucketed tables, postings and documents, plus small metadata.

Layout under ``path``::

    manifest/                       one row: analyzer, stop words, parameters, corpus
    log/                            commits and checkpoints: which writings the segments are
    postings-<n>/segment=/field=/   doc_id, term, tf, dl; in n buckets by doc_id, sorted by term
    documents-<n>/segment=/field=/  doc_id, dl of all documents; in the same buckets
    terms/segment=/field=/          term, df, max_tf, min_dl; range-sorted by term
    snapshots/<name>/impacts-<n>/field= term, doc_id, partial; bucketed like the postings
    snapshots/<name>/dictionary/field=  term, df, term_id, start, end
    snapshots/<name>/info/          parameters and segments the snapshot was made from

Postings are sharded by document, not by term. All postings of a document share
a bucket, so a query batch is scored and cut to its best k inside each bucket
and only k rows per query and bucket are shuffled; no term, however frequent,
can overload a task. Within a bucket file rows are sorted by term, so Parquet
statistics leave only the row groups of the query terms to be read.

Every writing has a folder of its own (``segment=`` holds its number, not the
segment's), and a commit in the log says which one a segment is. Replaced ones
stay until :meth:`Index.vacuum` finds them old enough, so an index that was
opened earlier keeps answering. Segments are merged by size, and the number of
buckets doubles when they grow too large; neither shuffles anything.
"""

from __future__ import annotations

import hashlib
import math
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.text import ANALYZERS, ENGLISH_STOP_WORDS
from ..operators import dictionary as D
from ..operators import postings as P
from ..operators import search as S
from ..operators.batch import match_only, search_chunks, total_hits
from ..operators.bounds import search_literal
from .log import CommitLog, Files, State

DEFAULT_FIELD = "body"
#: Segment numbers that a stream has to itself.
STREAM_SEGMENTS = 1_000_000
#: Numbers from here on are given to segments that were merged by size.
COMPACTED = 1 << 40
#: So many segments of about the same size are merged into one.
FANOUT = 10
#: Postings of the smallest size that is told apart.
SMALLEST_TIER = 100_000
#: Buckets are split when they hold more than this on average.
BUCKET_BYTES = 1 << 30
MOST_BUCKETS = 1 << 17
#: How long replaced files stay.
GRACE_SECONDS = 7 * 24 * 3600
FORMAT = 3

MANIFEST_SCHEMA = (
    "format int, analyzer string, stop_words array<string>, shards int, bucket_bytes long, fanout int, "
    "k1 double, b double, quantize boolean, corpus string"
)
TERMS_SCHEMA = "term string, df long, max_tf int, min_dl int, segment long, field string"
DICTIONARY_SCHEMA = "term string, df long, term_id long, start long, end long, field string"
INFO_SCHEMA = "field string, k1 double, b double, quantize boolean, vocabulary string, commits array<string>, buckets int"
COUNTS = ("n_docs", "total_docs", "sum_ttf", "n_postings")


#: Stands for "whatever vocabulary a snapshot has".
ANY_VOCABULARY = object()


def _vocabulary_hash(vocabulary: DataFrame | Iterable[str] | None) -> str:
    """``all``, or a hash of the distinct words."""
    if vocabulary is None:
        return "all"
    if isinstance(vocabulary, DataFrame):
        words = vocabulary.select(F.col(vocabulary.columns[0]).alias("w")).where("w is not null").distinct()
        return str(tuple(words.agg(F.count("w"), F.bit_xor(F.xxhash64("w")), F.sum(F.xxhash64("w").cast("decimal(38,0)"))).first()))
    return hashlib.sha1("\n".join(sorted(set(vocabulary))).encode()).hexdigest()


class StaleIndexError(ValueError):
    """The stored files do not belong to what the caller asked for."""


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files under ``path`` as one hash; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = files.select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    return str(one.agg(F.count("h"), F.bit_xor("h")).first())


def size_tiers(sizes: Mapping[int, int], fanout: int) -> list[int]:
    """Segments of the smallest full tier: those within one power of ``fanout`` in size, if there are as many.

    Merging them until no tier is full leaves fewer than ``fanout`` segments a
    tier, and tiers grow with the logarithm of the corpus.
    """
    tiers: dict[int, list[int]] = {}
    for number, size in sizes.items():
        tiers.setdefault(int(math.log(max(size / SMALLEST_TIER, 1), fanout) + 1e-9), []).append(number)
    full = [tier for tier, members in tiers.items() if len(members) >= fanout]
    return sorted(tiers[min(full)]) if full else []


class Index:
    """Build, extend, open and search a stored index."""

    def __init__(self, spark: SparkSession, path: str, manifest: Mapping):
        self.spark = spark
        self.path = path.rstrip("/")
        self.manifest = dict(manifest)
        self._files = Files(spark, self.path)
        self._log = CommitLog(spark, f"{self.path}/log")
        self._seen: State | None = None
        self._collections: dict[str, S.Collection] = {}
        self._registered: set[tuple] = set()

    # ---- open and create ------------------------------------------------

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        analyzer: str = "standard",
        stop_words: Iterable[str] | None = None,
        shards: int | None = None,
        k1: float = bm25.K1,
        b: float = bm25.B,
        quantize: bool = True,
        corpus: str = "",
        bucket_bytes: int = BUCKET_BYTES,
        fanout: int = FANOUT,
    ) -> Index:
        """An empty index.

        ``shards`` is the first number of buckets; it defaults to what the first
        documents' size asks for, at least ``spark.sql.shuffle.partitions``, and
        doubles whenever buckets pass ``bucket_bytes``. ``fanout`` segments of
        like size are merged (0: never). ``stop_words`` defaults to the 33
        English ones for the ``standard`` analyzer and to none for others.
        """
        if analyzer not in ANALYZERS:
            raise ValueError(f"unknown analyzer {analyzer!r}; expected one of {sorted(ANALYZERS)}")
        if stop_words is None:
            stop_words = ENGLISH_STOP_WORDS if analyzer == "standard" else ()
        manifest = {
            "format": FORMAT,
            "analyzer": analyzer,
            "stop_words": list(stop_words),
            "shards": shards,
            "bucket_bytes": int(bucket_bytes),
            "fanout": int(fanout),
            "k1": float(k1),
            "b": float(b),
            "quantize": bool(quantize),
            "corpus": corpus,
        }
        frame = spark.createDataFrame([tuple(manifest.values())], MANIFEST_SCHEMA)
        frame.coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/manifest")
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **expected) -> Index:
        """Open a stored index; ``expected`` manifest values that differ raise ``StaleIndexError``."""
        manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path.rstrip('/')}/manifest").first()
        if manifest is None:
            raise StaleIndexError(f"no index manifest in {path}")
        manifest = manifest.asDict()
        for key, value in {"format": FORMAT, **expected}.items():
            value = list(value) if key == "stop_words" else value
            if manifest.get(key) != value:
                raise StaleIndexError(f"index has {key}={manifest.get(key)!r}, expected {value!r}")
        index = cls(spark, path, manifest)
        index._state()
        return index

    @classmethod
    def build(cls, spark: SparkSession, path: str, documents: DataFrame, **options) -> Index:
        """Create an index and load ``documents(doc_id, text[, field])`` as its first segment."""
        index = cls.create(spark, path, **options)
        index.append(documents, 0)
        return index

    def _table(self, kind: str, columns: str, partitions: str, buckets: int, order: str = "term, doc_id") -> str:
        """Register a bucketed table over ``path/kind``; buckets exist through the catalog only."""
        name = "rankspark_" + hashlib.sha1(f"{self.path}/{kind}/{buckets}".encode()).hexdigest()[:16]
        if (name,) not in self._registered:
            location = f"{self.path}/{kind}".replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {partitions}) USING parquet "
                f"OPTIONS (compression 'zstd') PARTITIONED BY ({', '.join(p.split()[0] for p in partitions.split(','))}) "
                f"CLUSTERED BY (doc_id) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{location}'"
            )
            self._registered.add((name,))
        return name

    def _postings_table(self, buckets: int) -> str:
        return self._table(f"postings-{buckets}", "doc_id BIGINT, term STRING, tf INT, dl INT", "segment BIGINT, field STRING", buckets)

    def _documents_table(self, buckets: int) -> str:
        return self._table(f"documents-{buckets}", "doc_id BIGINT, dl INT", "segment BIGINT, field STRING", buckets, "doc_id")

    @property
    def buckets(self) -> int:
        """How many buckets all current segments have."""
        held = [s["buckets"] for s in self._state().segments.values()]
        return held[0] if held else self.manifest["shards"] or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def _postings(self) -> str:
        return self._postings_table(self.buckets)

    @property
    def _documents(self) -> str:
        return self._documents_table(self.buckets)

    # ---- metadata -------------------------------------------------------

    def _state(self) -> State:
        """What was committed when this index was opened, last written or refreshed."""
        if self._seen is None:
            self._seen = self._log.read()
            self._register()
        return self._seen

    def _register(self) -> None:
        """Make the tables' folders of current segments known to the session, some hundreds a statement; nothing is listed."""
        missing: dict[str, list[str]] = {}
        for segment in self._seen.segments.values():
            for table in (self._postings_table(segment["buckets"]), self._documents_table(segment["buckets"])):
                for field in segment["fields"]:
                    key = (table, segment["writing"], field)
                    if key not in self._registered:
                        name = field.replace("\\", "\\\\").replace("'", "\\'")
                        missing.setdefault(table, []).append(f"PARTITION (segment = {segment['writing']}, field = '{name}')")
                        self._registered.add(key)
        for table, parts in missing.items():
            for low in range(0, len(parts), 200):
                self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(parts[low : low + 200])}")

    def _check_number(self, segment: int) -> int:
        """A number that was merged away stays hidden for ever, so nothing may be written to it."""
        self._forget()
        if self._state().is_merged(int(segment)):
            raise ValueError(f"segment {segment} was merged into another; take {self.free_segment()} or above")
        return int(segment)

    def was_merged(self, segment: int) -> bool:
        """Whether the documents of ``segment`` are part of another one by now."""
        self._forget()
        return self._state().is_merged(int(segment))

    def free_segment(self) -> int:
        """The least number above all that were ever given to segments by their writers."""
        state = self._state()
        used = [n for n in state.segments if n < COMPACTED] + [high for _, high in state.merged if high < COMPACTED]
        return max(used, default=-1) + 1

    def stream_start(self, name: str) -> int:
        """The first segment of a named stream: the same again after a restart, else a free million of its own."""
        where = f"streams/{hashlib.sha1(name.encode()).hexdigest()}"
        if not self._files.exists(f"{where}/_SUCCESS"):
            self._forget()
            taken = self.free_segment()
            if self._files.exists("streams"):
                others = self.spark.read.option("recursiveFileLookup", "true").schema("first long").parquet(f"{self.path}/streams")
                taken = max(taken, (others.agg(F.max("first")).first()[0] or -1) + 1)
            first = -(-taken // STREAM_SEGMENTS) * STREAM_SEGMENTS
            self.spark.createDataFrame([(first,)], "first long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{where}")
        return self.spark.read.schema("first long").parquet(f"{self.path}/{where}").first()[0]

    def refresh(self) -> None:
        """See segments other writers have committed since this index was opened."""
        self._forget()
        self._state()

    def segments(self) -> list[int]:
        return sorted(self._state().segments)

    def fields(self) -> list[str]:
        return sorted({field for s in self._state().segments.values() for field in s["fields"]})

    def stats(self, field: str = DEFAULT_FIELD) -> dict:
        """Collection statistics, added up over segments."""
        held = {number: s for number, s in self._state().segments.items() if field in s["fields"]}
        if not held:
            raise ValueError(f"no field {field!r} in this index; it has {self.fields()}")
        total = {k: sum(s["fields"][field][k] for s in held.values()) for k in COUNTS}
        total["avgdl"] = total["sum_ttf"] / total["n_docs"] if total["n_docs"] else None
        total["segments"] = sorted(held)
        total["writings"] = sorted(s["writing"] for s in held.values())
        total["commits"] = sorted(s["commit"] for s in held.values())
        return total

    # ---- writing --------------------------------------------------------

    def append(self, documents: DataFrame, segment: int) -> None:
        """Write ``documents`` as one segment; writing a segment again replaces it.

        One shuffle, of texts by document id. Ids must be unique per field
        across segments. A number that was merged away raises ``ValueError``.
        Afterwards segments of like size are merged and large buckets split.
        """
        segment = self._check_number(segment)
        buckets = self.buckets if self._state().segments else self._first_buckets(documents)
        if segment in self._state().segments:
            # Withdrawn before it is written again, so a failure half-way leaves it out.
            self._commit({"withdraw": segment})
        columns = ["doc_id", "text", "field" if "field" in documents.columns else F.lit(DEFAULT_FIELD).alias("field")]
        placed = documents.select(*columns).repartition(buckets, "doc_id")
        tokenized = P.tokenize(placed, self.manifest["analyzer"], self.manifest["stop_words"])
        self._write_segment(P.build_postings(tokenized, keep_empty=True), segment, [], buckets)
        self._grow()
        if self.manifest["fanout"]:
            self.compact()

    def _first_buckets(self, documents: DataFrame) -> int:
        least = self.manifest["shards"] or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if self.manifest["shards"]:
            return least
        # What Spark expects of the plan; far too large where it knows nothing.
        expected = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        wanted = math.ceil(expected / self.manifest["bucket_bytes"])
        return max(least, wanted) if wanted <= MOST_BUCKETS else least

    def merge(self, into: int, segments: Iterable[int] | None = None) -> None:
        """Rewrite several committed segments as one; buckets are kept, so nothing is shuffled.

        May be called again with the same ``into`` after a failure.
        """
        into = self._check_number(into)
        old = sorted(set(segments if segments is not None else self.segments()))
        if into in self.segments():
            raise ValueError(f"segment {into} exists")
        if unknown := set(old) - set(self.segments()):
            raise ValueError(f"segments {sorted(unknown)} are not committed or were merged already")
        self._rewrite(old, into, self.buckets)

    def compact(self, fanout: int | None = None) -> None:
        """Merge segments of like size until fewer than ``fanout`` of any size are left."""
        fanout = fanout or self.manifest["fanout"] or FANOUT
        while True:
            sizes = {n: sum(f["n_postings"] for f in s["fields"].values()) for n, s in self._state().segments.items()}
            chosen = size_tiers(sizes, fanout)
            if not chosen:
                return
            self._rewrite(chosen, self._free_compacted(), self.buckets)

    def _free_compacted(self) -> int:
        state = self._state()
        return max([COMPACTED - 1, *state.segments, *(high for _, high in state.merged)]) + 1

    def _grow(self) -> None:
        """Double the buckets until they hold no more than they should on average; rows move within their task."""
        size = sum(s["bytes"] for s in self._state().segments.values())
        buckets = self.buckets
        while size / buckets > self.manifest["bucket_bytes"] and 2 * buckets <= MOST_BUCKETS:
            buckets *= 2
        if buckets > self.buckets:
            self._rewrite(self.segments(), self._free_compacted(), buckets)

    def _current(self, old: list[int]) -> DataFrame:
        """Postings of some segments, by document and term."""
        writings = [self._state().segments[n]["writing"] for n in old]
        rows = self.spark.table(self._postings).filter(F.col("segment").isin(writings))
        return rows.groupBy("field", "doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"), F.max("dl").alias("dl"))

    def _rewrite(self, old: list[int], into: int, buckets: int) -> None:
        """Put ``old`` into one segment of ``buckets`` buckets, a multiple of what there are: bucket i goes to i, i + n, …"""
        self._write_segment(self._current(old), into, old, buckets)

    def _write_segment(self, rows: DataFrame, segment: int, replaces: list[int], buckets: int) -> None:
        # A number of its own: what a failed attempt leaves is never read.
        writing = uuid.uuid4().int >> 65
        postings, documents = self._postings_table(buckets), self._documents_table(buckets)
        rows = rows.select("doc_id", "term", "tf", "dl", "field")
        self._insert(postings, rows, f"segment = {writing}, field", overwrite=False)
        self.spark.catalog.refreshTable(postings)

        mine = self.spark.table(postings).filter(F.col("segment") == writing)
        of_terms = F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
        terms = mine.filter(F.col("term").isNotNull()).groupBy("field", "term").agg(*of_terms)
        folder = f"{self.path}/terms/segment={writing}"
        terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(folder)

        lengths = mine.groupBy("field", "doc_id").agg(F.max("dl").alias("dl")).select("doc_id", "dl", "field")
        self._insert(documents, lengths, f"segment = {writing}, field", overwrite=False)
        self.spark.catalog.refreshTable(documents)

        of_field = self.spark.table(documents).filter(F.col("segment") == writing).groupBy("field")
        counted = of_field.agg(
            F.count_if(F.col("dl") > 0).alias("n_docs"), F.count(F.lit(1)).alias("total_docs"), F.sum("dl").cast("long").alias("sum_ttf")
        )
        # One row per field.
        fields = {r["field"]: {**{c: r[c] for c in COUNTS[:3]}, "n_postings": 0} for r in counted.collect()}
        written = self.spark.read.schema(TERMS_SCHEMA).parquet(f"{self.path}/terms").filter(F.col("segment") == writing)
        for row in written.groupBy("field").agg(F.sum("df").alias("n")).collect():
            fields[row["field"]]["n_postings"] = row["n"]
        size = self._files.size(f"postings-{buckets}/segment={writing}")
        holds = {"writing": writing, "commit": uuid.uuid4().hex, "buckets": buckets, "bytes": size, "fields": fields}
        # Written last: from here on readers see the segment.
        self._commit({"segment": int(segment), "replaces": [int(n) for n in replaces], "holds": holds})

    def _commit(self, entry: dict) -> None:
        self._forget()
        self._seen = self._log.commit(entry)
        self._register()

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> list[int]:
        """Delete writings that were replaced, or never committed, so long ago; gives their numbers."""
        self._forget()
        state, before = self._state(), time.time() - grace_seconds
        old = {(writing, buckets) for writing, buckets, when in state.doomed if when <= before}
        known = {s["writing"] for s in state.segments.values()} | {d[0] for d in state.doomed}
        for folder in self._files.names():
            kind, _, buckets = folder.partition("-")
            if folder != "terms" and kind not in ("postings", "documents"):
                continue
            for name in self._files.names(folder):
                writing = int(name.removeprefix("segment=")) if name.startswith("segment=") else None
                if writing is not None and writing not in known and self._files.changed(f"{folder}/{name}") <= before:
                    old.add((writing, int(buckets) if buckets else None))
        for writing, buckets in old:
            self._files.delete(f"terms/segment={writing}")
            if buckets:
                for kind, table in (("postings", self._postings_table(buckets)), ("documents", self._documents_table(buckets))):
                    self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (segment = {writing})")
                    self._files.delete(f"{kind}-{buckets}/segment={writing}")
        removed = sorted({writing for writing, _ in old})
        if removed:
            self._commit({"removed": removed})
        return removed

    def _forget(self) -> None:
        self._seen = None
        self._collections.clear()

    def _insert(self, table: str, rows: DataFrame, partition: str, overwrite: bool) -> None:
        session = rows.sparkSession  # a streaming batch has its own, and views belong to a session
        view = f"rankspark_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        try:
            verb = "OVERWRITE" if overwrite else "INTO"
            session.sql(f"INSERT {verb} TABLE {table} PARTITION ({partition}) SELECT * FROM {view}")
        finally:
            session.catalog.dropTempView(view)

    # ---- reading --------------------------------------------------------

    def _terms(self, field: str) -> DataFrame:
        writings = self.stats(field)["writings"]
        terms = self.spark.read.schema(TERMS_SCHEMA).parquet(f"{self.path}/terms")
        return terms.filter((F.col("field") == field) & F.col("segment").isin(writings))

    def dictionary(self, field: str = DEFAULT_FIELD) -> DataFrame:
        """``(term, df)`` over all committed segments."""
        mine = self._terms(field)
        if len(self.stats(field)["writings"]) == 1:
            return mine.select("term", "df")
        return mine.groupBy("term").agg(F.sum("df").alias("df"))

    def bounds(self, field: str = DEFAULT_FIELD) -> DataFrame:
        """``(term, max_tf, min_dl)``: no posting of a term weighs more than one with these would."""
        return self._terms(field).groupBy("term").agg(F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))

    def _rows(self, table: str, field: str, writings: list[int]) -> DataFrame:
        return self.spark.table(table).filter((F.col("field") == field) & F.col("segment").isin(writings))

    def collection(self, field: str = DEFAULT_FIELD) -> S.Collection:
        """The field with statistics as constants and the stored dictionary."""
        if field in self._collections:
            return self._collections[field]
        stats = self.stats(field)
        self._collections[field] = S.Collection(
            postings=self._rows(self._postings, field, stats["writings"]).filter(F.col("term").isNotNull()).select("doc_id", "term", "tf", "dl"),
            lengths=self._rows(self._documents, field, stats["writings"]).select("doc_id", "dl"),
            n_docs=F.lit(stats["n_docs"]),
            avgdl=F.lit(stats["avgdl"]).cast("double"),
            dictionary=self.dictionary(field),
            bounds=self.bounds(field),
            k1=self.manifest["k1"],
            b=self.manifest["b"],
            quantize=self.manifest["quantize"],
        )
        return self._collections[field]

    def search(
        self,
        queries: object,
        k: int = 10,
        field: str = DEFAULT_FIELD,
        accept: DataFrame | None = None,
        snapshot: str | None = None,
        vocabulary: object = ANY_VOCABULARY,
        **options,
    ) -> DataFrame:
        """Best ``k`` documents per query; all of them when ``k < 0``.

        ``snapshot`` reads precomputed partial scores instead of raw postings,
        a given ``vocabulary`` (None: all words) must be the one it was made for;
        ``options`` (``k1``, ``b``, ``quantize``, ``use_norms``) apply to the latter.
        """
        queries = S.any_of(self.spark, queries)
        if snapshot is not None:
            if options:
                raise ValueError("a snapshot has its parameters built in")
            return S.search_impacts(self.impacts(field, snapshot, vocabulary), queries, k, accept)
        collection = self.collection(field).with_options(**options)
        if queries.literal is None:
            return search_chunks(collection, queries, k, accept)
        return search_literal(collection, queries, k, accept)

    def totals(self, queries: object, field: str = DEFAULT_FIELD, accept: DataFrame | None = None) -> DataFrame:
        """``(query_id, total_hits, max_score)`` of every query, also of those that match nothing."""
        return total_hits(self.collection(field), S.any_of(self.spark, queries), accept)

    def matches(self, queries: object, field: str = DEFAULT_FIELD, accept: DataFrame | None = None) -> DataFrame:
        """``(query_id, doc_id)`` of all matching documents, unscored."""
        return match_only(self.collection(field), S.any_of(self.spark, queries), accept)

    # ---- snapshots ------------------------------------------------------

    def snapshot(self, name: str = "default", vocabulary: DataFrame | Iterable[str] | None = None) -> None:
        """Store the partial scores and the dictionary of all committed segments.

        Scores depend on collection totals, so later segments make it stale.
        """
        base = f"snapshots/{name}"
        # Withdrawn first: a snapshot that is being rewritten answers nothing.
        self._files.delete(f"{base}/info")
        table = self._snapshot_table(name, self.buckets)
        info = []
        dictionaries = None
        for field in self.fields():
            stats = self.stats(field)
            collection = self.collection(field)
            rows = S.impacts(collection, vocabulary, stats["n_postings"], self.buckets)
            self._insert(
                table, rows.select("doc_id", "term", "partial"), "field = '{}'".format(field.replace("'", "\\'")), True
            )
            words = P.keep_terms(self.dictionary(field), vocabulary)
            words = D.term_dictionary(words).withColumn("field", F.lit(field))
            dictionaries = words if dictionaries is None else dictionaries.unionByName(words)
            m = self.manifest
            info.append((field, m["k1"], m["b"], m["quantize"], _vocabulary_hash(vocabulary), stats["commits"], self.buckets))
        if not info:
            raise ValueError("the index is empty")
        dictionaries.write.mode("overwrite").partitionBy("field").parquet(f"{self.path}/{base}/dictionary")
        self.spark.createDataFrame(info, INFO_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/{base}/info"
        )

    def _snapshot_table(self, name: str, buckets: int) -> str:
        kind = f"snapshots/{name}/impacts-{buckets}"
        table = self._table(kind, "doc_id BIGINT, term STRING, partial DOUBLE", "field STRING", buckets)
        if self._files.exists(kind):
            self.spark.catalog.recoverPartitions(table)
        return table

    def _check_snapshot(self, field: str, name: str, vocabulary: object = ANY_VOCABULARY) -> int:
        """The snapshot's number of buckets, once it is known to be good."""
        where = f"snapshots/{name}/info"
        if not self._files.exists(where):
            raise StaleIndexError(f"no snapshot {name!r}")
        row = self.spark.read.schema(INFO_SCHEMA).parquet(f"{self.path}/{where}").filter(F.col("field") == field).first()
        if row is None:
            raise ValueError(f"no field {field!r} in snapshot {name!r}")
        if sorted(row["commits"]) != self.stats(field)["commits"]:
            raise StaleIndexError(f"snapshot {name!r} was made from other segments; take it again")
        if vocabulary is not ANY_VOCABULARY and row["vocabulary"] != _vocabulary_hash(vocabulary):
            raise StaleIndexError(f"snapshot {name!r} was made for another vocabulary")
        return row["buckets"]

    def impacts(self, field: str = DEFAULT_FIELD, snapshot: str = "default", vocabulary: object = ANY_VOCABULARY) -> DataFrame:
        """``(term, doc_id, partial)`` as stored; a given ``vocabulary`` (None: all words) must be the snapshot's."""
        table = self._snapshot_table(snapshot, self._check_snapshot(field, snapshot, vocabulary))
        return self.spark.table(table).filter(F.col("field") == field).select("term", "doc_id", "partial")

    def offsets(self, field: str = DEFAULT_FIELD, snapshot: str = "default") -> DataFrame:
        """``(term, df, term_id, start, end)`` as stored."""
        self._check_snapshot(field, snapshot)
        stored = self.spark.read.schema(DICTIONARY_SCHEMA).parquet(f"{self.path}/snapshots/{snapshot}/dictionary")
        return stored.filter(F.col("field") == field).drop("field")
