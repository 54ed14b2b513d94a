"""Score posts as they arrive, with models fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagspark.functions.clean import clean_questions
from tagspark.operators.features import TfidfModel
from tagspark.operators.scoring import LinearModel, predict_tags, score


def score_arrivals(
    posts: DataFrame,
    text_model: TfidfModel,
    model: LinearModel,
    out: str,
    checkpoint: str,
    key: str = "idx",
) -> StreamingQuery:
    """Write `(key, tags)` of a stream `(key, title, body)` to `out`.

    Cleaning is part of the stream; each micro-batch is then scored like a
    batch. A batch that is run again replaces its own folder, so its answers
    appear once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        features = text_model.transform(batch, keep=(key,), bias=True)
        answers = predict_tags(score(features, model, (key,)), model.tags, (key,))
        answers.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        clean_questions(posts.select(key, "title", "body"))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
