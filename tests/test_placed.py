"""Features counted where their documents are, and trainings that share them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_plans import exchanges, fixed_plans, plan  # noqa: F401
from tagspark.operators import features, joins, training
from tagspark.plans import jobs

ROWS = [
    (0, "aa bb aa bb cc"), (1, "bb cc"), (1, "bb cc"), (1, "cc dd"), (2, ""), (3, "c# +"), (4, None),
    (None, "aa bb"), (None, "aa bb"), (None, "dd"), (5, "aa"),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, (i or 0) % 3) for i, t in ROWS]
    return spark.createDataFrame(rows, "idx long, text string, labels long").repartition(4, "idx")


def ordered(df):
    return sorted((tuple(-1 if x is None else x for x in r) for r in df.collect()), key=lambda r: r)


@pytest.mark.parametrize("bias", [False, True])
@pytest.mark.parametrize("size", [None, 1 << 40])
def test_placed_features_are_the_same(docs, bias, size):
    model = features.TfidfModel.fit(docs, 0.0)
    keep = ("idx", "labels")
    want = ordered(model.transform(docs, keep, bias).drop("term"))
    model._bytes = size
    got = ordered(model.transform_placed(docs, keep, bias))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_placed_features_are_counted_after_the_lookup(docs, fixed_plans):  # noqa: F811
    model = features.TfidfModel.fit(docs, 0.0)
    text = plan(model.transform_placed(docs, bias=True))
    # Nothing moves but the texts, and no function of arrays runs uncompiled over the grams.
    assert exchanges(model.transform_placed(docs, bias=True)) == 1 and "hashpartitioning(idx" in text
    assert "sort_array" not in text and "zip_with" not in text and "zipwith" not in text
    assert text.index("HashAggregate") < text.index("BroadcastHashJoin") < text.index("Generate")


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, -1])
def test_pairs_count_once_a_document(docs, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
    for share in (0.0, 0.15, 0.25):
        want = ordered(features.vocabulary(features.doc_freq(docs), len(ROWS), share))
        assert ordered(features.frequent_terms(docs, len(ROWS), share)) == want


def test_neighbours_are_looked_up_before_they_are_joined(docs, fixed_plans):  # noqa: F811
    text = plan(features.frequent_terms(docs, len(ROWS), 0.1))
    assert "substring_index" not in text and "zipwith" not in text
    assert text.count("LeftSemi") == 2


def test_tags_in_batches_share_the_features(spark, monkeypatch):
    rows = [(i, "red apple" if i % 2 else "green pear", f"{'x' if i % 2 else 'y'} {'z' if i % 3 else 'u'} v{i % 4}") for i in range(24)]
    docs = spark.createDataFrame(rows, "idx long, text string, tags string").withColumn("position", F.col("idx"))
    model = features.TfidfModel.fit(docs, 0.0)
    stats = jobs.tag_rank(docs)
    prepared = jobs.Prepared(docs, docs, model, stats)
    settings = training.Settings(iterations=2, score_every=2)
    calls, store = [], jobs.stored_rows

    def counting(*args):
        calls.append(args[1])
        return store(*args)

    monkeypatch.setattr(jobs, "stored_rows", counting)
    together = jobs.train_all(prepared, 3, 2, 19, 6, settings, batches=2)
    assert calls == ["train", "valid"] and len(together.tags) == 3
    got = {r["feature_id"]: r["w"] for r in together.weights.collect()}
    for first, size in ((0, 2), (2, 1)):
        alone = jobs.train(prepared, first, size, 19, 6, settings, 2).model
        assert together.tags[first : first + size] == alone.tags
        for r in alone.weights.collect():
            assert np.allclose(got[r["feature_id"]][first : first + size], r["w"])
