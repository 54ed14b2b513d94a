"""The three jobs: prepare the data, train the tags, answer the test posts."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from tagspark.functions.clean import clean_questions
from tagspark.operators.dedup import (
    dedup_by_title, drop_known, known_tags, match_known, merge_answers,
)
from tagspark.operators.features import MIN_DF, TfidfModel
from tagspark.operators.ordering import slice_rows, split_rows, with_row_index
from tagspark.operators.scoring import LinearModel, label_bits, predict_tags, score
from tagspark.operators.tagstats import tag_names, tag_rank
from tagspark.operators.training import (
    Settings, Trained, packed_rows, stored_rows, train_stored, train_tags,
)
from tagspark.sources.staging import cut, discard, spread, stage

# Fixed values.
FIT_END = 3500000
VALIDATION_ROWS = 2000
TAGS_PER_BATCH = 16
PREDICTED_TAGS = 50
# End of fixed values.

# Batches of tags that are trained at the same time: one's tasks run while the other's are planned.
BATCHES_AT_ONCE = 2


@dataclass
class Prepared:
    """Tables every later step reads.

    `documents` is the stored clean text, with the `position` of each row among them.
    """

    documents: DataFrame
    repeated: DataFrame
    text_model: TfidfModel
    tag_stats: DataFrame


def prepare(
    train: DataFrame, test: DataFrame, min_df: float = MIN_DF, end: int = -1
) -> Prepared:
    """Drop repeated titles, match the test titles, fit text and tag vocabularies.

    `train` is `(idx, title, body, tags)`, `test` is `(test_idx, title, body)`.
    The clean text is written once and read by every later pass. Vocabularies and tag ranks are
    fitted on all rows; a record number `end` (`FIT_END`, say) bounds them to the rows before it.
    Record numbers count the rows that are left after repeated titles are dropped.
    """
    repeated = cut(match_known(test, train))
    documents = positioned(clean_questions(dedup_by_title(train)))
    fitted = slice_rows(documents, 0, end, "position")
    return Prepared(
        documents, repeated, TfidfModel.fit(fitted, min_df), cut(tag_rank(fitted))
    )


def positioned(documents: DataFrame) -> DataFrame:
    """Documents, stored, with their dense `position` in the order of `idx`."""
    documents = stage(documents, "clean")
    places = with_row_index(documents.select("idx"), "idx", name="position")
    return stage(documents.join(places, "idx"), "documents")


def training_features(
    documents: DataFrame, text_model: TfidfModel, names: Sequence[str]
) -> DataFrame:
    """`(idx, labels, feature_id, value)` with bias rows, for one batch of tags."""
    return labelled_features(documents, text_model, label_bits(F.col("tags"), names))


def labelled_features(documents: DataFrame, text_model: TfidfModel, labels: Column) -> DataFrame:
    """`(idx, labels, feature_id, value)` with bias rows; `labels` are made from `tags`."""
    # The texts are moved, not their features, which are many times larger.
    documents = spread(documents.select("idx", "text", "tags"), "idx")
    labelled = documents.select("idx", "text", labels.alias("labels"))
    return text_model.transform_placed(labelled, keep=("idx", "labels"), bias=True)


def train(
    prepared: Prepared,
    first: int = 0,
    n_tags: int = TAGS_PER_BATCH,
    n_train: int = FIT_END,
    n_valid: int = VALIDATION_ROWS,
    settings: Settings = Settings(),
    batches: int = 1,
    job: str | None = None,
) -> Trained:
    """Train the tags of the ranks `first` to `first + n_tags - 1`.

    The classifiers are fitted on the first `n_train` records and validated on the `n_valid`
    records after them, the header counted as one; labelled rows after these take no part. `job`
    is a folder from which a training that was interrupted goes on.
    """
    names = tag_names(prepared.tag_stats, n_tags, first)
    rows, held_out = split_rows(prepared.documents, n_train, n_valid, "position")
    return train_tags(
        training_features(rows, prepared.text_model, names),
        training_features(held_out, prepared.text_model, names),
        prepared.text_model.terms,
        names,
        settings,
        batches,
        job,
    )


def train_all(
    prepared: Prepared,
    n_tags: int = PREDICTED_TAGS,
    batch: int = TAGS_PER_BATCH,
    n_train: int = FIT_END,
    n_valid: int = VALIDATION_ROWS,
    settings: Settings = Settings(),
    batches: int = 1,
    job: str | None = None,
) -> LinearModel:
    """One model of the `n_tags` most frequent tags, or of all if there are fewer, trained
    `batch` tags at a time.

    The weights of the batches are joined per feature; a feature that a batch does not know has
    weight 0 there. The features are made and stored once, with the labels of every batch in an
    array. With a folder `job`, a run that was interrupted skips the batches it had ended and goes
    on inside the one it had begun.
    """
    names = tag_names(prepared.tag_stats, n_tags)
    dealt = [names[first : first + batch] for first in range(0, len(names), batch)]
    labels = F.array(*[label_bits(F.col("tags"), some) for some in dealt])
    rows, held_out = (
        packed_rows(labelled_features(part, prepared.text_model, labels))
        for part in split_rows(prepared.documents, n_train, n_valid, "position")
    )
    stored = stored_rows(rows, "train", batches), stored_rows(held_out, "valid")

    def model_of(k: int) -> LinearModel:
        of_batch = [t.withColumn("labels", F.get("labels", F.lit(k))) for t in stored]
        folder = f"{job}/tags-{k * batch:05d}" if job else None
        terms = prepared.text_model.terms
        return train_stored(*of_batch, terms, dealt[k], settings, batches, job=folder).model

    with ThreadPoolExecutor(BATCHES_AT_ONCE) as pool:
        trained = [pool.submit(inheritable_thread_target(stored[0].sparkSession)(model_of), k) for k in range(len(dealt))]
        models = [t.result() for t in trained]
    for table in stored:
        discard(table)
    return join_models(models)


def join_models(models: Sequence[LinearModel]) -> LinearModel:
    """One model of all the tags, in order."""
    weights = models[0].weights.select("feature_id", "w")
    n = len(models[0].tags)

    def or_zeros(w: str, size: int) -> Column:
        return F.coalesce(w, F.array_repeat(F.lit(0.0), size))

    for model in models[1:]:
        more = model.weights.select("feature_id", F.col("w").alias("more"))
        both = F.concat(or_zeros("w", n), or_zeros("more", len(model.tags)))
        weights = weights.join(more, "feature_id", "full").select("feature_id", both.alias("w"))
        n += len(model.tags)
    return LinearModel(cut(weights), [t for m in models for t in m.tags])


def predict(
    test: DataFrame,
    repeated: DataFrame,
    text_model: TfidfModel,
    model: LinearModel,
) -> DataFrame:
    """`(test_idx, tags)` of the test posts without a known answer."""
    documents = clean_questions(drop_known(test, repeated))
    features = text_model.transform(documents, keep=("test_idx",), bias=True)
    return predict_tags(score(features, model, ("test_idx",)), model.tags)


def submission(
    test: DataFrame,
    train: DataFrame,
    repeated: DataFrame,
    text_model: TfidfModel,
    model: LinearModel,
) -> DataFrame:
    """`(Id, Tags)` of every test post, known answers first."""
    return merge_answers(
        test, known_tags(repeated, train), predict(test, repeated, text_model, model)
    )
