"""The registered queries: each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagspark.functions.clean import (
    ascii_lower, clean_questions, clean_title, extract_blocks, join_fragments, keep_chars,
    process_body, spell_numbers, strip_brackets, strip_tags, tag_detected, trim_words,
    unescape_angle,
)
from tagspark.functions.losses import sigmoid, squared_hinge
from tagspark.operators import dedup, features as feats, ordering, projection as proj
from tagspark.operators import scoring, tagstats, training
from tagspark.operators.features import BIAS_ID, BIAS_TERM, TfidfModel
from tagspark.plans import jobs
from tagspark.plans.fixtures import odds_weights, q_docs, q_pages, q_test, q_train, table
from tagspark.plans.settings import (
    ALL_TRAINING, BINS, MARGIN_NOISE_SEED, MARGIN_STEP_RATE, MARGIN_TRAINING, MIN_DF, N_TAGS, NOISE_BATCH,
    NOISE_PASSES, PROJECTION_DIMS, RUN_RANKS, SCORED_STEPS, TAG_TRAINING, TRAIN_TAGS, WIDE_DIMS,
)
from tagspark.sources import models, questions as files
from tagspark.sources.questions import FIRST_TEST_ID, read_questions, write_questions
from tagspark.sources.staging import cut, new_path, spread, stage
from tagspark.streaming.scoring import score_arrivals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r6(c: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def n_rows(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "documents").count()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def clean_train(spark: SparkSession, sf: str) -> DataFrame:
    return clean_questions(q_train(spark, sf))


def train_stats(spark: SparkSession, sf: str, n: int = N_TAGS) -> tuple[DataFrame, list[str]]:
    stats = cut(tagstats.tag_rank(q_train(spark, sf)))
    return stats, tagstats.tag_names(stats, n)


def fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, TfidfModel]:
    """The clean training posts, stored once, and their text model."""
    docs = jobs.positioned(clean_train(spark, sf))
    return docs, TfidfModel.fit(docs, MIN_DF)


def scored_train(
    spark: SparkSession, sf: str
) -> tuple[DataFrame, TfidfModel, scoring.LinearModel]:
    """`(idx, labels, feature_id, value)` of the training posts, with both models."""
    docs, text_model = fitted(spark, sf)
    _, names = train_stats(spark, sf)
    rows = stage(jobs.training_features(docs, text_model, names), "training-features")
    return rows, text_model, odds_weights(rows, names)


def margins(spark: SparkSession, sf: str) -> tuple[DataFrame, scoring.LinearModel]:
    """`(idx, rank, output, target)`: linear outputs of all tags before the sigmoid."""
    rows, _, model = scored_train(spark, sf)
    n = len(model.tags)
    blocks = scoring.in_blocks(model.weights, n)
    sums = scoring.linear_sums(rows, blocks, model.size_bytes, ["idx", "labels"])
    pairs = scoring.tag_rows(sums, n, ["idx", "labels"], "output")
    target = F.expr(f"2D * {scoring.label_bit('rank')} - 1").alias("target")
    return pairs.select("idx", F.col("rank").cast("long").alias("rank"), "output", target), model


# Scans, sources, sinks.


@query
def scan_questions(spark, sf):
    path = new_path(spark, "csv")
    named = q_docs(spark, sf).toDF("Id", "Title", "Body", "Tags")
    write_questions(named, path)
    return read_questions(spark, path)


@query
def scan_test_questions(spark, sf):
    path = new_path(spark, "csv")
    ids = (F.col("test_idx") + FIRST_TEST_ID).alias("Id")
    write_questions(
        q_test(spark, sf).select(ids, F.col("title").alias("Title"), F.col("body").alias("Body")),
        path,
    )
    return read_questions(spark, path, testing=True)


@query
def write_questions_deduped(spark, sf):
    path = new_path(spark, "csv")
    write_questions(dedup.dedup_by_title(q_docs(spark, sf)).toDF("Id", "Title", "Body", "Tags"), path)
    return read_questions(spark, path)


@query
def row_index(spark, sf):
    # Texts repeat, so the id completes the key.
    return ordering.with_row_index(documents(spark, sf), "text", "doc_id").drop("text")


@query
def slice_rows(spark, sf):
    n = n_rows(spark, sf)
    return ordering.slice_rows(q_docs(spark, sf).select("idx", "title"), n // 4, n // 2)


@query
def count_records(spark, sf):
    return ordering.count_records(table(spark, sf, "documents"))


@query
def model_roundtrip(spark, sf):
    _, text_model, tag_model = scored_train(spark, sf)
    path = new_path(spark, "model")
    models.save_text_model(text_model, f"{path}/text")
    models.save_tag_model(tag_model, f"{path}/tags")
    text_back = models.load_text_model(spark, f"{path}/text")
    tag_back = models.load_tag_model(spark, f"{path}/tags")
    n_docs = F.lit(text_back.n_docs).cast("double")
    names = F.posexplode(F.array(*[F.lit(t) for t in tag_back.tags])).alias("position", "name")
    parts = [
        text_back.terms.select(
            F.lit("term").alias("kind"), F.col("term").alias("name"),
            F.col("feature_id").alias("position"), r6("idf").alias("value"),
        ),
        spark.range(1).select(F.lit("tag").alias("kind"), names).select(
            "kind", "name", F.col("position").cast("long").alias("position"), F.lit(0.0).alias("value")
        ),
        tag_back.long_form().select(
            F.lit("weight").alias("kind"), F.col("feature_id").cast("string").alias("name"),
            F.col("rank").cast("long").alias("position"), r6("w").alias("value"),
        ),
        spark.range(1).select(
            F.lit("corpus").alias("kind"), F.lit("n_docs").alias("name"),
            F.lit(0).cast("long").alias("position"), n_docs.alias("value"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Projections, filters, joins.


@query
def project_tags(spark, sf):
    return q_docs(spark, sf).select("idx", "tags")


@query
def drop_known(spark, sf):
    test = q_test(spark, sf)
    known = dedup.match_known(test, q_train(spark, sf))
    return dedup.drop_known(test.select("test_idx", "title"), known)


@query
def tag_detected_in_body(spark, sf):
    rows = q_docs(spark, sf).select(
        "idx", ascii_lower(F.col("body")).alias("body"), F.explode(F.split("tags", " ", -1)).alias("tag")
    )
    return rows.select("idx", "tag", tag_detected(F.col("tag"), F.col("body")).alias("detected"))


@query
def match_known(spark, sf):
    return dedup.match_known(q_test(spark, sf), q_train(spark, sf))


@query
def known_tags(spark, sf):
    train = q_train(spark, sf)
    return dedup.known_tags(cut(dedup.match_known(q_test(spark, sf), train)), train)


@query
def merge_answers(spark, sf):
    # The guesses stand for predictions of the posts without a known answer.
    test, train = q_test(spark, sf), q_train(spark, sf)
    repeated = cut(dedup.match_known(test, train))
    guesses = dedup.drop_known(test, repeated).select(
        "test_idx", F.concat(F.lit("guess-"), F.col("test_idx").cast("string")).alias("tags")
    )
    return dedup.merge_answers(test, dedup.known_tags(repeated, train), guesses)


# Aggregations and windows.


@query
def dedup_by_title(spark, sf):
    return dedup.dedup_by_title(q_docs(spark, sf))


@query
def first_per_title(spark, sf):
    return dedup.first_per_title(q_docs(spark, sf))


@query
def tag_counts(spark, sf):
    return tagstats.tag_counts(q_docs(spark, sf))


@query
def tag_occurrences(spark, sf):
    docs = q_docs(spark, sf)
    return tagstats.tag_occurrences(docs, cut(tagstats.tag_offsets(docs)))


@query
def occurrence_runs(spark, sf):
    """The runs of some tags, read from the written occurrences by their offsets."""
    docs = q_docs(spark, sf)
    stats = cut(tagstats.tag_rank(docs))
    index = tagstats.index_occurrences(docs, stats, part_rows=max(1, n_rows(spark, sf) // 4))
    low, high = RUN_RANKS
    return index.runs(tagstats.top_tags(stats, high - low + 1, low))


@query
def top_words_by_bin(spark, sf):
    return tagstats.top_words_by_bin(clean_questions(q_docs(spark, sf)), BINS, n_rows(spark, sf) + 1)


@query
def top_tags_by_bin(spark, sf):
    return tagstats.top_tags_by_bin(q_docs(spark, sf), BINS, n_rows(spark, sf) + 1)


@query
def row_bins(spark, sf):
    total = n_rows(spark, sf) + 1
    return q_docs(spark, sf).select("idx", ordering.bin_of(F.col("idx"), total, BINS).alias("bin"))


@query
def doc_freq(spark, sf):
    return feats.doc_freq(clean_questions(q_docs(spark, sf)))


@query
def term_freq(spark, sf):
    return feats.term_freq(clean_questions(q_docs(spark, sf))).select(
        "idx", "term", F.col("tf").cast("long").alias("tf")
    )


@query
def tag_coverage(spark, sf):
    return tagstats.tag_coverage(q_docs(spark, sf))


@query
def running_coverage(spark, sf):
    return tagstats.running_coverage(q_docs(spark, sf))


@query
def repeat_rate(spark, sf):
    test = q_test(spark, sf)
    return dedup.repeat_rate(test, dedup.match_known(test, q_train(spark, sf)))


@query
def eval_margin(spark, sf):
    outputs, model = margins(spark, sf)
    w = model.long_form().filter(F.col("feature_id") != BIAS_ID)
    squares = w.groupBy("rank").agg(F.sum(F.col("w") * F.col("w")).alias("squares"))
    measured = scoring.eval_margin(outputs, squares)
    names = ("mean_abs_error", "loss", "penalty")
    return measured.select(F.col("rank").cast("long").alias("rank"), *[r6(c).alias(c) for c in names])


@query
def f_measure(spark, sf):
    rows, _, model = scored_train(spark, sf)
    scored = scoring.score(rows, model, ("idx", "labels"))
    return scoring.f_measure(scored).select(
        F.col("rank").cast("long").alias("rank"), r6("soft_f").alias("soft_f"), r6("hard_f").alias("hard_f")
    )


@query
def tag_rank(spark, sf):
    return tagstats.tag_rank(q_docs(spark, sf))


@query
def tag_offsets(spark, sf):
    return tagstats.run_widths(cut(tagstats.tag_offsets(q_docs(spark, sf))))


@query
def top_tags(spark, sf):
    return tagstats.top_tags(tagstats.tag_rank(q_docs(spark, sf)), 16, 2).select("rank", "tag")


@query
def vocab_index(spark, sf):
    docs = stage(clean_questions(q_docs(spark, sf)), "documents")
    return TfidfModel.fit(docs, MIN_DF).terms.select("term", "feature_id")


# The cleaner.


@query
def ascii_lower_text(spark, sf):
    return documents(spark, sf).select("doc_id", ascii_lower(F.col("text")).alias("lowered"))


def posts_and_pages(spark, sf):
    return (
        q_docs(spark, sf)
        .drop("tags")
        .unionByName(q_pages(spark, sf).withColumn("idx", F.lit(-1) - F.col("idx")))
    )


@query
def extract_blocks_joined(spark, sf):
    low = posts_and_pages(spark, sf).select("idx", ascii_lower(F.col("body")).alias("body"))
    names = ("p", "li", "code", "pre")
    return extract_blocks(low).select(
        "idx",
        *[F.size(b).cast("long").alias(f"n_{b}") for b in names],
        *[F.array_join(b, "|").alias(b) for b in names],
    )


@query
def join_fragments_text(spark, sf):
    low = posts_and_pages(spark, sf).select("idx", ascii_lower(F.col("body")).alias("body"))
    return extract_blocks(low).select(
        "idx", *[join_fragments(F.col(b)).alias(b) for b in ("p", "li", "code", "pre")]
    )


def lower_html(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.withColumn("html", ascii_lower(F.col("html")))


@query
def unescape_angle_html(spark, sf):
    return lower_html(spark, sf).withColumn("html", unescape_angle(F.col("html")))


@query
def strip_tags_html(spark, sf):
    return lower_html(spark, sf).withColumn("html", strip_tags(F.col("html")))


@query
def strip_brackets_body(spark, sf):
    return posts_and_pages(spark, sf).select("idx", strip_brackets(F.col("body")).alias("body"))


def kept_text(spark, sf):
    return documents(spark, sf).select(
        "doc_id", keep_chars(ascii_lower(F.col("text"))).alias("kept")
    )


@query
def keep_chars_text(spark, sf):
    return kept_text(spark, sf)


@query
def spell_numbers_text(spark, sf):
    return kept_text(spark, sf).select("doc_id", spell_numbers(F.col("kept")).alias("spelled"))


@query
def trim_words_text(spark, sf):
    return kept_text(spark, sf).select("doc_id", trim_words(F.col("kept")).alias("trimmed"))


@query
def clean_titles(spark, sf):
    return q_docs(spark, sf).select("idx", clean_title(F.col("title")).alias("title"))


@query
def process_bodies(spark, sf):
    low = q_docs(spark, sf).select("idx", ascii_lower(F.col("body")).alias("body"))
    return process_body(low, byte_blanks=True).select(
        "idx", "processed", F.octet_length("processed").cast("long").alias("n_bytes")
    )


@query
def clean_posts(spark, sf):
    return clean_questions(q_docs(spark, sf)).select("idx", "text")


@query
def clean_pages(spark, sf):
    return clean_questions(q_pages(spark, sf))


# Text features.


@query
def tokens(spark, sf):
    from tagspark.functions.text import tokens as tokens_of

    tok = clean_questions(q_docs(spark, sf)).select("idx", tokens_of(F.col("text")).alias("tok"))
    return tok.select(
        "idx", F.size("tok").cast("long").alias("n_tokens"), F.array_join("tok", " ").alias("tokens")
    )


@query
def ngrams(spark, sf):
    return feats.term_counts(clean_questions(q_docs(spark, sf)))


@query
def vocabulary(spark, sf):
    docs = stage(clean_questions(q_docs(spark, sf)), "documents")
    return feats.frequent_terms(docs, n_rows(spark, sf), MIN_DF)


@query
def idf(spark, sf):
    docs = clean_questions(q_docs(spark, sf))
    n = n_rows(spark, sf)
    terms = feats.vocabulary(feats.doc_freq(docs), n, MIN_DF)
    return terms.select("term", r6(feats.idf_of(F.col("df"), n)).alias("idf"))


@query
def tag_vocab(spark, sf):
    return tagstats.tag_vocabulary(q_docs(spark, sf))


@query
def tag_ids(spark, sf):
    docs = q_docs(spark, sf)
    return tagstats.tag_ids(docs, cut(tagstats.tag_offsets(docs)))


def docs_tfidf(spark, sf):
    docs = stage(clean_questions(q_docs(spark, sf)), "documents")
    model = TfidfModel.fit(docs, MIN_DF)
    return model.transform(spread(docs, "idx")), model


@query
def tfidf(spark, sf):
    values, _ = docs_tfidf(spark, sf)
    return values.select("idx", "term", r6("value").alias("value"))


@query
def tfidf_transform_test(spark, sf):
    _, model = fitted(spark, sf)
    values = model.transform(clean_questions(q_test(spark, sf)), keep=("test_idx",))
    return values.select("test_idx", "term", "feature_id", r6("value").alias("value"))


@query
def feature_rows(spark, sf):
    values, model = docs_tfidf(spark, sf)
    rows = feats.to_vectors(values, model.terms.count())
    zero = F.lit(0.0)
    pairs = F.arrays_zip("indices", "values")
    return rows.select(
        "idx",
        F.size("indices").cast("long").alias("nnz"),
        F.array_min("indices").alias("first_id"),
        F.array_max("indices").alias("last_id"),
        r6(F.aggregate("values", zero, lambda s, v: s + v)).alias("total"),
        r6(F.aggregate("values", zero, lambda s, v: s + v * v)).alias("norm"),
        r6(F.aggregate(pairs, zero, lambda s, p: s + p["values"] * p["indices"])).alias("moment"),
    )


def train_cells(spark, sf, dims=PROJECTION_DIMS):
    docs, model = fitted(spark, sf)
    cells = proj.projection(model.terms, model.terms.count(), dims)
    return docs, model, cells


def projected_train(spark, sf, dims=PROJECTION_DIMS):
    """`(idx, values)` of the training posts, an array of all dimensions."""
    docs, model, cells = train_cells(spark, sf, dims)
    return proj.projected_rows(model.transform(spread(docs, "idx"), bias=True), stage(cells, "cells"), dims)


@query
def projection(spark, sf):
    return train_cells(spark, sf)[2]


@query
def projection_wide(spark, sf):
    """The non-zero cells at the whole width."""
    return train_cells(spark, sf, WIDE_DIMS)[2]


@query
def project_features(spark, sf):
    docs, model, cells = train_cells(spark, sf)
    projected = proj.project(model.transform(spread(docs, "idx")), stage(cells, "cells"))
    return projected.select("idx", "dim", r6("value").alias("value"))


@query
def project_wide(spark, sf):
    """What a post's array of the whole width sums up to, in four ways."""
    rows = projected_train(spark, sf, WIDE_DIMS)
    zero, v = F.lit(0.0), F.col("values")
    moment = F.aggregate(F.transform(v, lambda x, d: x * d), zero, lambda s, x: s + x)
    return rows.select(
        "idx",
        F.size(v).cast("long").alias("width"),
        r6(F.aggregate(v, zero, lambda s, x: s + x)).alias("total"),
        r6(F.aggregate(v, zero, lambda s, x: s + x * x)).alias("norm"),
        r6(moment / WIDE_DIMS).alias("moment"),
        r6(F.array_max(v)).alias("largest"),
    )


@query
def noise_schedule(spark, sf):
    max_steps = NOISE_PASSES * q_train(spark, sf).count() // NOISE_BATCH
    return q_docs(spark, sf).select(
        F.col("idx").alias("step"), r6(proj.noise_level(F.col("idx"), max_steps)).alias("level")
    )


@query
def corrupt(spark, sf):
    noisy = proj.corrupt_row(F.col("values"), F.lit(0.5), F.col("idx"), PROJECTION_DIMS, 7)
    rows = projected_train(spark, sf).select("idx", F.posexplode(noisy).alias("dim", "value"))
    return rows.select("idx", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


# Labels, training, prediction.


@query
def ovr_targets(spark, sf):
    _, names = train_stats(spark, sf)
    return scoring.targets(q_train(spark, sf), names).withColumn("rank", F.col("rank").cast("long"))


@query
def label_targets(spark, sf):
    labels = table(spark, sf, "labels")
    both = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("label"), (F.col(c) * 2 - 1).alias("target"))
                for c in ("quality", "toxic")
            ]
        )
    )
    return labels.select("doc_id", both)


@query
def split_rows(spark, sf):
    n = n_rows(spark, sf)
    train, valid = ordering.split_rows(q_docs(spark, sf).select("idx"), n // 2, n // 4)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )


def with_terms(spark, rows, model):
    """Add the `term` of each feature; the bias has the empty one."""
    bias = spark.range(1).select(
        F.lit(BIAS_ID).cast("long").alias("feature_id"), F.lit(BIAS_TERM).alias("term")
    )
    return rows.join(model.terms.select("feature_id", "term").unionByName(bias), "feature_id")


def one_step(spark, sf, settings, start_of):
    """State and gradients after one pass from the weights `start_of(rows, model, names)`, for the
    first tags, one row per term and tag."""
    docs, model = fitted(spark, sf)
    _, names = train_stats(spark, sf, TRAIN_TAGS)
    rows = training.stored_rows(training.packed_rows(jobs.training_features(docs, model, names)), "train")
    start = stage(start_of(training.unfolded(rows, ["idx", "labels"]), model, names), "state")
    sums = training.gradient_sums(
        rows, training.block_columns(start), start.count() * 120, settings.loss
    )
    state = stage(training.with_sums(start, sums), "state")
    pairs = ", ".join(
        f"struct({scoring.rank_of(r)} as rank, " + ", ".join(f"get({c}, {r}) as {c}" for c in ("w", "ms", "mom", "g")) + ")"
        for r in range(scoring.BLOCK)
    )
    long_form = training.with_gradients(state, settings).selectExpr("feature_id", f"inline(array({pairs}))")
    return with_terms(spark, long_form.filter(F.col("rank") < len(names)), model).withColumn(
        "rank", F.col("rank").cast("long")
    )


def first_step(spark, sf):
    """A step without decay from weights that are all 0."""
    settings = training.Settings(weight_decay=0.0)
    rows = one_step(
        spark, sf, settings, lambda _, model, names: training.initial_state(model.terms, len(names))
    )
    return rows, settings


@query
def train_step(spark, sf):
    rows, _ = first_step(spark, sf)
    return rows.select("rank", "term", r6("g").alias("gradient"))


@query
def rmsprop_step(spark, sf):
    rows, settings = first_step(spark, sf)
    w, ms, mom = map(F.expr, training.rmsprop(settings))
    return rows.select("rank", "term", r6(w).alias("w"), r6(ms).alias("ms"), r6(mom).alias("mom"))


@query
def train_step_decay(spark, sf):
    """The gradient at weights that are not 0, with decay."""

    def start_of(rows, model, names):
        odds = odds_weights(rows, names)
        zeros = F.array_repeat(F.lit(0.0), scoring.BLOCK)
        w = F.array(*[f"w{r}" for r in range(scoring.BLOCK)]).alias("w")
        return scoring.in_blocks(odds.weights, len(names)).select(
            "feature_id", "block", w, *[zeros.alias(c) for c in training.STATE[1:]]
        )

    rows = one_step(spark, sf, training.Settings(), start_of)
    return rows.select("rank", "term", r6("w").alias("w"), r6("g").alias("gradient"))


def _trained_weights(model: scoring.LinearModel) -> DataFrame:
    return model.long_form().select(F.col("rank").cast("long").alias("rank"), "feature_id", r6("w").alias("w"))


def split_sizes(n: int) -> tuple[int, int]:
    """Records for training and for validation: three quarters, and the rest."""
    return n * 3 // 4, n + 1 - n * 3 // 4


def training_settings(numbers: tuple[int, int, int], **more) -> training.Settings:
    return training.Settings(iterations=numbers[0], score_every=numbers[1], **more)


@query
def train_tags(spark, sf):
    docs, model = fitted(spark, sf)
    stats, _ = train_stats(spark, sf, TRAIN_TAGS)
    prepared = jobs.Prepared(docs, docs, model, stats)
    trained = jobs.train(
        prepared, 0, TRAIN_TAGS, *split_sizes(docs.count()), training_settings(TAG_TRAINING), batches=TAG_TRAINING[2]
    )
    return _trained_weights(trained.model)


@query
def train_all_tags(spark, sf):
    """All predicted tags, trained in batches of tags, as one model."""
    docs, model = fitted(spark, sf)
    stats, _ = train_stats(spark, sf)
    prepared = jobs.Prepared(docs, docs, model, stats)
    return _trained_weights(
        jobs.train_all(
            prepared, N_TAGS, jobs.TAGS_PER_BATCH, *split_sizes(docs.count()), training_settings(ALL_TRAINING),
            job=new_path(spark, "job"),
        )
    )


@query
def train_margin(spark, sf):
    """Squared hinge on noisy projected features, an array per post."""
    docs, model = fitted(spark, sf)
    _, names = train_stats(spark, sf, TRAIN_TAGS)
    k = PROJECTION_DIMS
    cells = stage(proj.projection(model.terms, model.terms.count(), k), "cells")
    labelled = spread(docs, "idx").select(
        "idx", "text", "position", scoring.label_bits(F.col("tags"), names).alias("labels")
    )
    keep = ("idx", "labels", "position")
    features = model.transform(labelled, keep=keep, bias=True)
    values = proj.projected_rows(features, cells, k)
    bias = F.array(F.struct(F.lit(BIAS_ID).cast("long").alias("feature_id"), F.lit(1.0).alias("value")))
    dense = F.transform(
        "values", lambda v, d: F.struct(d.cast("long").alias("feature_id"), v.alias("value"))
    )
    rows = stage(
        values.join(labelled.drop("text"), "idx").select(*keep, F.concat(dense, bias).alias("features")), "dense"
    )
    parts = [p.drop("position") for p in ordering.split_rows(rows, *split_sizes(docs.count()), "position")]
    settings = training_settings(MARGIN_TRAINING, loss="squared_hinge", step_rate=MARGIN_STEP_RATE)
    trained = training.train_packed(
        *parts,
        spark.range(k).select(F.col("id").alias("feature_id")),
        names,
        settings,
        MARGIN_TRAINING[2],
        training.dense_noise(k, settings.iterations, MARGIN_NOISE_SEED),
    )
    return _trained_weights(trained.model)


@query
def prepare_positions(spark, sf):
    """Positions of the posts that are left after repeated titles are dropped."""
    left = dedup.dedup_by_title(q_train(spark, sf))
    return jobs.positioned(clean_questions(left)).select("position", "idx")


@query
def predict_batches(spark, sf):
    """Tags predicted by one model that was joined from batches of tags."""
    rows, text_model, _ = scored_train(spark, sf)
    _, names = train_stats(spark, sf)
    size = jobs.TAGS_PER_BATCH
    parts = []
    for first in range(0, len(names), size):
        some = names[first : first + size]
        labels = F.shiftright("labels", first)
        parts.append(odds_weights(rows.withColumn("labels", labels), some))
    features = text_model.transform(
        clean_questions(q_test(spark, sf)), keep=("test_idx",), bias=True
    )
    model = jobs.join_models(parts)
    return scoring.predict_tags(scoring.score(features, model, ("test_idx",)), model.tags)


@query
def best_iteration(spark, sf):
    outputs, _ = margins(spark, sf)
    steps = F.explode(F.array(*[F.lit(s) for s in SCORED_STEPS])).alias("iteration")
    y = (F.col("target") + 1) / 2
    p = sigmoid(F.col("output") * F.col("iteration") / 10)
    from tagspark.functions.losses import soft_f_measure

    scores = (
        outputs.select("rank", "output", "target", steps)
        .groupBy("rank", "iteration")
        .agg(r6(soft_f_measure(F.sum(y * p), F.sum(y + p))).alias("score"))
    )
    return scoring.best_iteration(scores).select(
        "rank", "iteration", "score"
    )


@query
def squared_hinge_loss(spark, sf):
    outputs, _ = margins(spark, sf)
    return outputs.select(
        "idx", "rank",
        r6(squared_hinge(F.col("target"), F.col("output"))).alias("loss"),
    )


def scored_test(spark, sf):
    _, text_model, model = scored_train(spark, sf)
    features = text_model.transform(
        clean_questions(q_test(spark, sf)), keep=("test_idx",), bias=True
    )
    return scoring.score(features, model, ("test_idx",)), text_model, model


@query
def score_tags(spark, sf):
    scored, _, _ = scored_test(spark, sf)
    return scoring.score_rows(scored, ("test_idx",)).select(
        "test_idx", F.col("rank").cast("long").alias("rank"), r6("score").alias("score")
    )


@query
def predict_tags(spark, sf):
    scored, _, model = scored_test(spark, sf)
    return scoring.predict_tags(scored, model.tags)


@query
def predict_unanswered(spark, sf):
    _, text_model, model = scored_train(spark, sf)
    test = q_test(spark, sf)
    repeated = cut(dedup.match_known(test, q_train(spark, sf)))
    return jobs.predict(test, repeated, text_model, model)


@query
def submission(spark, sf):
    _, text_model, model = scored_train(spark, sf)
    test, train = q_test(spark, sf), q_train(spark, sf)
    repeated = cut(dedup.match_known(test, train))
    return jobs.submission(test, train, repeated, text_model, model)


@query
def submission_files(spark, sf):
    """From question files to the two answer files, read back in their order."""
    folder = new_path(spark, "files")
    write_questions(q_train(spark, sf).toDF(*files.TRAIN_COLUMNS), f"{folder}/train")
    ids = (F.col("test_idx") + FIRST_TEST_ID).alias("Id")
    test_file = q_test(spark, sf).select(ids, F.col("title").alias("Title"), F.col("body").alias("Body"))
    write_questions(test_file, f"{folder}/test")
    train = stage(files.train_posts(read_questions(spark, f"{folder}/train")), "train-posts")
    test = stage(files.test_posts(read_questions(spark, f"{folder}/test", testing=True)), "test-posts")

    docs = jobs.positioned(clean_questions(train))
    text_model = TfidfModel.fit(docs, MIN_DF)
    names = tagstats.tag_names(cut(tagstats.tag_rank(train)), N_TAGS)
    rows = stage(jobs.training_features(docs, text_model, names), "training-features")
    model = odds_weights(rows, names)
    repeated = cut(dedup.match_known(test, train))
    predicted = stage(jobs.predict(test, repeated, text_model, model), "predicted")
    files.write_presubmission(predicted, f"{folder}/presubmission")
    answers = dedup.merge_answers(test, dedup.known_tags(repeated, train), predicted)
    files.write_submission(answers, f"{folder}/submission")

    alone = files.read_ordered(spark, f"{folder}/presubmission", "Tags string")
    whole = files.read_ordered(spark, f"{folder}/submission", "Id long, Tags string")
    return whole.select(F.lit("submission").alias("file"), "position", "Id", "Tags").unionByName(
        alone.select(
            F.lit("presubmission").alias("file"), "position", F.lit(None).cast("long").alias("Id"), "Tags"
        )
    )


@query
def score_stream(spark, sf):
    """The test posts as a stream of files, scored in micro-batches."""
    _, text_model, model = scored_train(spark, sf)
    posts = stage(q_test(spark, sf), "arrivals")
    stream = spark.readStream.schema(posts.schema).parquet(posts.inputFiles()[0].rsplit("/", 1)[0])
    out = new_path(spark, "answers")
    score_arrivals(
        stream, text_model, model, out, new_path(spark, "stream"), "test_idx"
    ).awaitTermination()
    return spark.read.parquet(out).select("test_idx", "tags")


# Names under which the operators are listed.
_NAMES = {
    "write_questions_deduped": "write_questions",
    "tag_detected_in_body": "tag_detected",
    "ascii_lower_text": "ascii_lower",
    "extract_blocks_joined": "extract_blocks",
    "join_fragments_text": "join_fragments",
    "unescape_angle_html": "unescape_angle",
    "strip_tags_html": "strip_tags",
    "strip_brackets_body": "strip_brackets",
    "keep_chars_text": "keep_chars",
    "spell_numbers_text": "spell_numbers",
    "trim_words_text": "trim_words",
    "clean_titles": "clean_title",
    "process_bodies": "process_body",
    "clean_posts": "clean_questions",
    "squared_hinge_loss": "squared_hinge",
}
for _function, _name in _NAMES.items():
    _QUERIES[_name] = _QUERIES.pop(_function)
