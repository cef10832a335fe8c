"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query
runs once to warm up and then ``BENCH_RUNS`` times; the median counts. The
index is built once beforehand and timed by itself, warm.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import rankspark as R  # noqa: E402
from rankspark.functions import text as X  # noqa: E402
from rankspark.operators import batch as B  # noqa: E402
from rankspark.operators import search as S  # noqa: E402
from rankspark.plans import queries as Q  # noqa: E402

FIVE_TERMS = ["the", "of", "und", "que", "anshwh"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    work = tempfile.mkdtemp(prefix="rankspark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rankspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{work}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    documents = Q.documents(spark, sf_dir)
    built = []

    def build() -> None:
        built.append(R.Index.build(spark, f"{work}/index{len(built)}", documents, analyzer="simple"))

    def timed(action) -> float:
        start = time.perf_counter()
        action()
        return time.perf_counter() - start

    def median(action, times: int = runs) -> float:
        action()
        return statistics.median(timed(action) for _ in range(times))

    seconds = {"index_build": median(build, 1)}
    index = built[-1]
    collection = index.collection()

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat_ws("-", "conv_id", "turn").alias("item_id"), "text"
    )

    def batch(texts):
        return S.any_of(spark, S.queries_from_text(texts, "item_id", X.tokens("text", "simple")))

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    searches = {
        "five_terms_top10": lambda: index.search(FIVE_TERMS, 10),
        "benchmark_batch_top10": lambda: index.search(batch(benchmark), 10),
        "conversations_batch_top10": lambda: index.search(batch(turns), 10),
        "benchmark_batch_totals": lambda: B.total_hits(collection, batch(benchmark)),
        "conversations_batch_totals": lambda: B.total_hits(collection, batch(turns)),
        "score_all_docs": lambda: S.score_all(collection, S.any_of(spark, FIVE_TERMS)),
    }
    scans = {
        name: (lambda f: lambda: f(spark, sf_dir))(Q.QUERIES[name])
        for name in ("term_freq", "doc_freq", "collection_stats", "term_offsets", "bm25_topk_scan", "geo_nearest")
    }
    for name, query in {**searches, **scans}.items():
        seconds[name] = median(lambda: query().write.format("noop").mode("overwrite").save())
    seconds["impacts"] = median(
        lambda: S.impacts(collection, n_postings=index.stats()["n_postings"])
        .write.format("noop").mode("overwrite").save()
    )

    rates = {}
    for name, texts in (("benchmark_batch_top10", benchmark), ("conversations_batch_top10", turns)):
        size = S.candidate_size(collection, batch(texts)).agg(F.sum("candidates")).first()[0]
        rates[name] = {"postings": size, "postings_per_sec": round(size / seconds[name])}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "postings_scored": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
