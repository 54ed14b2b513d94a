"""Steps whose cost must not grow faster than the tables."""

import math
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.functions.clean import extract_blocks, normalize
from tagspark.operators import features, projection, training
from tagspark.operators.features import BIAS_ID
from tagspark.sources import staging


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_spread_scan_has_small_partitions(spark, tmp_path, monkeypatch):
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(staging, "SPREAD_BYTES", 2000)
    assert staging.spread(rows, "id").rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_blocks_are_found_without_reluctant_patterns(spark):
    rows = spark.createDataFrame([("<p>a<b>c</p><code>d</code><pre x>e</pre><li>f</li><p g",)], "body string")
    found = extract_blocks(rows)
    assert ".*?" not in plan(found)
    assert tuple(found.first())[1:] == (["a<b>c"], ["f"], ["d"], ["e"])


def test_texts_without_marks_are_normalised_alike(spark):
    texts = ["a b", "a <b> c", "[x] {y} z", "a &lt;b&gt; 12 c", "", None, "a 7 b > ] } c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] and " ".join(r["n"].split()) for r in rows.select(normalize(F.col("t")).alias("n")).collect()]
    assert got == ["a b", "a c", "z", "a one two c", "", None, "a seven b c"]


def test_counts_of_one_document_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "ab cd ab"), (2, "cd"), (3, "")], "idx long, text string")
    counted = features.term_counts(docs)
    assert "Exchange" not in plan(counted) and "Aggregate" not in plan(counted)
    want = {(1, "ab", 2), (1, "cd", 1), (1, "ab cd", 1), (1, "cd ab", 1), (2, "cd", 1)}
    assert {tuple(r) for r in counted.collect()} == want
    again = docs.union(spark.createDataFrame([(2, "cd ef"), (None, "ab"), (None, "ab")], "idx long, text string"))
    rows = [tuple(r) for r in features.term_counts(again).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want - {(2, "cd", 1)} | {(2, "cd", 2), (2, "ef", 1), (2, "cd ef", 1), (None, "ab", 2)}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_cells_are_added_up_in_arrays(spark, monkeypatch, batch):
    k, rng = 16, np.random.default_rng(5)
    rows = [(i, f, float(rng.normal())) for i in (None, *range(9)) for f in rng.choice(40, rng.integers(0, 9), False).tolist()]
    rows += [(i, BIAS_ID, 1.0) for i in (None, *range(9))]
    table = spark.createDataFrame(rows, "idx long, feature_id long, value double")
    cells = staging.stage(projection.projection(spark.range(40).withColumnRenamed("id", "feature_id"), 40, k), "cells")
    want = {i: np.zeros(k) for i in (None, *range(9))}
    signs = {}
    for f, d, s in cells.collect():
        signs.setdefault(f, []).append((d, s))
    for i, f, v in rows:
        for d, s in signs.get(f, []):
            want[i][d] += v * s
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = projection.projected_rows(table, cells, k)
        assert "hashpartitioning(idx#" in plan(got) and "dim" not in plan(got).split("MapInArrow")[0]
        # No group of a row and a dimension.
        assert "explode(_cells" not in plan(got)
        found = {r["idx"]: r["values"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.keys() == want.keys() and all(np.allclose(found[i], want[i]) for i in want)


def test_noise_is_added_to_unfolded_features(spark):
    k = 4
    pairs = [(d, float(d)) for d in range(k)] + [(BIAS_ID, 1.0)]
    rows = spark.createDataFrame([(i, 1, pairs) for i in range(5)], "idx long, labels long, features array<struct<feature_id:long,value:double>>")
    noise = training.dense_noise(k, 10, 3)
    packed = noise(rows, 2).select("idx", F.inline("features"))
    unfolded = noise(training.unfolded(rows, ["idx"]), 2)
    values = [{(r["idx"], r["feature_id"]): r["value"] for r in t.collect()} for t in (packed, unfolded)]
    assert values[0] == values[1] and not math.isclose(values[1][2, 1], 1.0)
    start = staging.stage(training.initial_state(spark.range(k).withColumnRenamed("id", "feature_id"), 1), "state")
    blocks = training.block_columns(start)
    sums = training.gradient_sums(rows, blocks, 1000, "squared_hinge", partial(noise, step=2))
    assert "transform(" not in plan(sums)
    want = training.gradient_sums(noise(rows, 2), blocks, 1000, "squared_hinge")
    got = [{r["feature_id"]: r["a"][0] for r in t.collect()} for t in (sums, want)]
    assert got[0].keys() == got[1].keys() and all(math.isclose(got[0][f], got[1][f], abs_tol=1e-9) for f in got[0])
