"""Question tables and submissions as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tagspark.operators.ordering import with_row_index

# The columns of the exchanged files, and the id of the first test row.
TRAIN_COLUMNS = ("Id", "Title", "Body", "Tags")
TEST_COLUMNS = ("Id", "Title", "Body")
FIRST_TEST_ID = 6034196
# End of fixed values.

# A quote inside a field is doubled, there is no escape character, and fields
# may hold line ends and blanks at either end.
_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_questions(spark: SparkSession, path: str, testing: bool = False) -> DataFrame:
    """Scan quoted, multi-line CSV with a header into typed columns without nulls.

    One file is one task, because a line end may be part of a field. Deliver
    large inputs as many files and convert them to parquet once. A record with too few or too
    many fields, or an id that is no number, and a header of other names stop the scan.
    """
    names = TEST_COLUMNS if testing else TRAIN_COLUMNS
    schema = T.StructType(
        [T.StructField(n, T.LongType() if n == "Id" else T.StringType()) for n in names]
    )
    raw = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", enforceSchema=False, **_DIALECT).csv(path)
    return raw.select("Id", *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names[1:]])


def write_questions(df: DataFrame, path: str) -> None:
    """Write a question table that `read_questions` gives back unchanged."""
    df.write.options(quoteAll=True, **_DIALECT).csv(path)


def train_posts(questions: DataFrame) -> DataFrame:
    """`(idx, title, body, tags)` of a training file, as the jobs want them, by its ids."""
    return questions.select(F.col("Id").alias("idx"), *[F.col(n).alias(n.lower()) for n in TRAIN_COLUMNS[1:]])


def test_posts(questions: DataFrame) -> DataFrame:
    """`(test_idx, title, body)` of a test file, whose ids follow `FIRST_TEST_ID`."""
    return questions.select(
        (F.col("Id") - FIRST_TEST_ID).alias("test_idx"), *[F.col(n).alias(n.lower()) for n in TEST_COLUMNS[1:]]
    )


def write_ordered(df: DataFrame, keys: list[str], columns: list[str], path: str) -> None:
    """Write `columns` in the order of `keys`, which need not be among them.

    The rows are range-partitioned, so the names of the part files follow the order of the rows.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    write_questions(ordered.select(*columns), path)


def write_submission(answers: DataFrame, path: str) -> None:
    """Write `(Id, Tags)` or `(test_idx, tags)` as a submission in the order of the ids."""
    if "test_idx" in answers.columns:
        answers = answers.select((F.col("test_idx") + FIRST_TEST_ID).alias("Id"), F.col("tags").alias("Tags"))
    write_ordered(answers, ["Id"], ["Id", "Tags"], path)


def write_presubmission(predictions: DataFrame, path: str) -> None:
    """Write the tags of `(test_idx, tags)` alone, in the order of the test rows."""
    write_ordered(predictions.withColumnRenamed("tags", "Tags"), ["test_idx"], ["Tags"], path)


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an ordered file with their `position`, from 0, over all its parts."""
    raw = spark.read.schema(schema).options(multiLine=True, mode="FAILFAST", enforceSchema=False, **_DIALECT).csv(path)
    texts = [f.name for f in raw.schema if isinstance(f.dataType, T.StringType)]
    # One file is one task, so the running id follows the records of a file.
    placed = raw.fillna("", texts).select(
        "*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at")
    )
    return with_row_index(placed, "_file", "_at", name="position").drop("_file", "_at")
