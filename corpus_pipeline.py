"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagspark.llm.mixing import apply_mix, mix_sources
from tagspark.llm.packing import pack_documents
from tagspark.llm.quality import keep_good
from tagspark.llm.queries import WORD_END, WORD_TOKENIZER, vocabulary
from tagspark.llm.simhash import keep_one, near_duplicates
from tagspark.llm.templates import drop_repeated_lines
from tagspark.sources.staging import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes keep, each row judged on its own."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one that has no text left goes."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id."""
    return keep_one(docs, near_duplicates(docs, shingle=4, distance=4))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return apply_mix(docs, mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and place."""
    return pack_documents(docs, vocabulary(WORD_TOKENIZER), WORD_END)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

# Estimation, hashing with XXH64 and packing have no SQL form; the tests compare the stages with
# plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
