"""What the operators of this package share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagspark.sources.staging import stage

# Words are separated by these characters only.
WORD = r"[^\x20\x09-\x0D]+"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; none for an empty or null one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_WORDS), "")


def document_key(docs: DataFrame) -> Column:
    """What names a document of `docs (doc_id, text, ...)`, with an order.

    That is its id, or, if rows share ids, which a count of the ids alone tells, its id and a hash
    of its text: only rows alike in both have one key.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.first() is None:
        return F.col("doc_id")
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def small_stage(df: DataFrame, name: str) -> DataFrame:
    """Store a table that is known to be small as one file."""
    return stage(df.coalesce(1), name)


def worker_memo(key: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for its later tasks."""
    memo = sys.__dict__.setdefault("_tagspark_llm_memo", {})
    if key not in memo:
        memo[key] = make()
    return memo[key]
