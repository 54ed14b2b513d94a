"""Trainings on matrices, and the whole training of all tags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, rows_of_sql
from conftest import SF
from tagspark.operators import matrices, training
from tagspark.operators.features import BIAS_ID
from tagspark.plans import catalog, jobs, oracles, settings as numbers

N, D, T = 60, 7, 11


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for i in range(N):
        labels = int(rng.integers(0, 1 << T))
        made.append((i, labels, BIAS_ID, 1.0))
        made += [(i, labels, int(f), float(rng.normal())) for f in rng.choice(D, 3, replace=False) * 5]
    return spark.createDataFrame(made, "idx long, labels long, feature_id long, value double")


def trained(spark, rows, loss, job=None, iterations=3):
    ids = spark.range(D + 1).select((F.col("id") * 5).alias("feature_id"))
    settings = training.Settings(loss=loss, iterations=iterations, score_every=2, step_rate=0.05)
    found = training.train_tags(rows, rows.filter("idx % 3 = 0"), ids, list("abcdefghijk"), settings, 2, job)
    return {r["feature_id"]: r["w"] for r in found.model.weights.collect()}, found.history


@pytest.mark.parametrize("loss, cells", [("f_measure", 10), ("squared_hinge", matrices.CELLS)])
def test_matrices_train_what_tables_train(spark, rows, monkeypatch, loss, cells):
    monkeypatch.setattr(matrices, "CELLS", cells)
    monkeypatch.setattr(matrices, "DIRECT_BYTES", cells)
    monkeypatch.setattr(matrices, "SLICE", 3)
    weights, history = trained(spark, rows, loss)
    monkeypatch.setattr(training, "ARRAY_BYTES", -1)
    want, scores = trained(spark, rows, loss)
    assert weights.keys() == want.keys() and all(np.allclose(weights[k], want[k]) for k in want)
    assert [i for i, _ in history] == [i for i, _ in scores] == [2, 3]
    assert np.allclose([s for _, s in history], [s for _, s in scores])


def test_tables_go_on_after_matrices(spark, rows, monkeypatch, tmp_path):
    want, _ = trained(spark, rows, "f_measure")
    for first, second in ((training.ARRAY_BYTES, -1), (-1, training.ARRAY_BYTES)):
        monkeypatch.setattr(training, "ARRAY_BYTES", first)
        trained(spark, rows, "f_measure", str(tmp_path / f"job{first}"), iterations=2)
        monkeypatch.setattr(training, "ARRAY_BYTES", second)
        got, _ = trained(spark, rows, "f_measure", str(tmp_path / f"job{first}"))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_repeated_ids_are_trained_in_tables(spark, rows, monkeypatch):
    calls = []
    monkeypatch.setattr(training, "matrix_sums", lambda *args: calls.append(args))
    twice = rows.unionByName(rows.filter("idx = 7").withColumn("labels", F.lit(1).cast("long")))
    trained(spark, twice, "f_measure", iterations=1)
    assert not calls


def test_all_tags_are_trained_to_the_end(spark, monkeypatch):
    made = [(i, "x y", "a b", i) for i in range(8)]
    docs = spark.createDataFrame(made, "idx long, text string, tags string, position long")
    given = []
    monkeypatch.setattr(catalog, "fitted", lambda *args: (docs, None))
    monkeypatch.setattr(catalog, "train_stats", lambda *args: (None, []))
    monkeypatch.setattr(catalog, "_trained_weights", lambda model: model)
    monkeypatch.setattr(jobs, "train_all", lambda *args, **more: given.append((args, more)))
    catalog.train_all_tags(spark, SF)
    (_, n_tags, batch, n_train, n_valid, settings), more = given[0]
    assert (n_tags, batch) == (jobs.PREDICTED_TAGS, jobs.TAGS_PER_BATCH) and (n_train, n_valid) == (6, 3)
    assert settings == jobs.Settings() and settings.iterations == 700 and more.get("batches", 1) == 1
    assert numbers.ALL_TRAINING == (settings.iterations, settings.score_every, 1)
    assert "where i <= 700" in oracles.oracles()["train_all_tags"]


def test_repeated_sql_is_the_unrolled_one():
    terms = ("train_x", "train_vocab")
    values = "select idx, feature_id, value from train_x"
    few = (5, 2, 2)
    want = oracles._training_ctes("brief", "few", "train_vocab", lambda i: values, few, "f_measure", 0.01, terms)
    got = oracles._long_training_sql("long", "few", "train_vocab", values, few, 0.01, terms)
    con = connect(SF)
    assert rows_of_sql(con, got) == rows_of_sql(con, want)
