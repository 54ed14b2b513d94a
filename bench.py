"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up, then $BENCH_REPEATS times (1 unless set); the
best time counts. Progress goes to standard error. All columns of all rows are
computed (noop sink). `train_iteration` is the time of one full-batch optimizer
step over all tags of a batch.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tagspark.operators import training
from tagspark.plans import catalog, jobs

QUERIES = (
    "clean_questions", "clean_pages", "dedup_by_title", "match_known", "tag_rank", "tag_coverage",
    "top_words_by_bin", "doc_freq", "tfidf", "score_tags", "submission",
)
ITERATIONS = 4
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()

    def run(name: str):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()

    seconds = {}
    for name in QUERIES:
        run(name)
        seconds[name] = round(min(timed(lambda: run(name)) for _ in range(REPEATS)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    docs, model = catalog.fitted(spark, sf_dir)
    stats, names = catalog.train_stats(spark, sf_dir, jobs.TAGS_PER_BATCH)
    n = docs.count()
    prepared = jobs.Prepared(docs, docs, model, stats)

    def train(iterations: int):
        settings = training.Settings(iterations=iterations, score_every=iterations)
        jobs.train(prepared, 0, len(names), n * 3 // 4, n + 1 - n * 3 // 4, settings)

    train(1)
    one, more = timed(lambda: train(1)), timed(lambda: train(1 + ITERATIONS))
    seconds["train_iteration"] = round(max(more - one, 0.0) / ITERATIONS, 3)

    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
