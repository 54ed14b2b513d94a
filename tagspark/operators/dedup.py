"""Duplicate titles, known answers and the merged result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagspark.operators.joins import split_lookup
from tagspark.sources.questions import FIRST_TEST_ID


def first_per_title(df: DataFrame, title: str = "title", idx: str = "idx") -> DataFrame:
    """`(title, idx)` of the first row with each title.

    Two narrow columns, combined before the shuffle: a title shared by a third
    of the rows costs one row per partition.
    """
    return df.groupBy(title).agg(F.min(idx).alias(idx))


def dedup_by_title(df: DataFrame, title: str = "title", idx: str = "idx") -> DataFrame:
    """Keep the first row of each title (null is one title).

    The wide rows meet the kept ids on the unique `idx`, never on the title,
    so no task receives all copies of a hot title.
    """
    return df.join(first_per_title(df, title, idx).select(idx), idx, "left_semi")


def match_known(test: DataFrame, train: DataFrame) -> DataFrame:
    """`(test_idx, train_idx)`: test rows whose title occurs in the raw training
    table, with the first such training row."""
    first = first_per_title(train).withColumnRenamed("idx", "train_idx")
    return split_lookup(test.select("test_idx", "title"), first, "title", "test_idx").select(
        "test_idx", "train_idx"
    )


def known_tags(repeated: DataFrame, train: DataFrame) -> DataFrame:
    """`(test_idx, tags)` of the matched rows. Many may point to one training row."""
    answers = train.select(F.col("idx").alias("train_idx"), "tags")
    return split_lookup(repeated, answers, "train_idx", "test_idx").select("test_idx", "tags")


def drop_known(test: DataFrame, repeated: DataFrame) -> DataFrame:
    """Test rows without a known answer."""
    return test.join(repeated.select("test_idx"), "test_idx", "left_anti")


def merge_answers(
    test: DataFrame, known: DataFrame, predicted: DataFrame, offset: int = FIRST_TEST_ID
) -> DataFrame:
    """`(Id, Tags)` of every test row: the known answer, else the predicted one, else ''."""
    return (
        test.select("test_idx")
        .join(known.select("test_idx", F.col("tags").alias("_known")), "test_idx", "left")
        .join(predicted.select("test_idx", F.col("tags").alias("_predicted")), "test_idx", "left")
        .select(
            (F.col("test_idx") + offset).alias("Id"),
            F.coalesce("_known", "_predicted", F.lit("")).alias("Tags"),
        )
    )


def repeat_rate(test: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row: known test rows and all test rows."""
    known = repeated.select("test_idx", F.lit(1).alias("_hit"))
    return (
        test.select("test_idx")
        .join(known, "test_idx", "left")
        .agg(F.count("_hit").alias("n_known"), F.count(F.lit(1)).alias("n_test"))
    )
