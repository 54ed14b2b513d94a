"""Ordering, lookups, duplicates, statistics and scoring on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.functions.hashing import PRIME, cell_hash, cell_normal, coefficients
from tagspark.operators import dedup, features, joins, ordering, projection, scoring, tagstats


def test_row_index_and_start_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    rows = ordering.with_row_index(df, "k", start_sums={"before": "v"}).collect()
    assert all(r["row_index"] == r["k"] and r["before"] == 2 * r["k"] for r in rows)
    assert len(rows) == 1000


@pytest.mark.parametrize("ranges", [1, 7, 16384])
def test_running_totals(spark, ranges):
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("v"))
    got = {r["idx"]: r["v"] for r in ordering.running_totals(df, "idx", ["v"], ranges).collect()}
    assert got == dict(enumerate(np.cumsum(np.arange(100) % 3).tolist()))


def test_slices(spark):
    df = spark.range(20).withColumnRenamed("id", "idx")
    ids = lambda d: sorted(r["idx"] for r in d.collect())
    assert ids(ordering.slice_rows(df, 0, 5)) == [0, 1, 2, 3]
    assert ids(ordering.slice_rows(df, 5, 7)) == [4, 5]
    assert ids(ordering.slice_rows(df, 18)) == [17, 18, 19]
    train, valid = ordering.split_rows(df, 5, 3)
    assert (ids(train), ids(valid)) == ([0, 1, 2, 3], [4, 5, 6])


def test_segments(spark):
    df = spark.range(10).select("id", ordering.bin_of(F.col("id"), 10, 3).alias("b")).orderBy("id")
    assert [r["b"] for r in df.collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    # With a divisor as the number of segments the last row is beyond them.
    df = spark.range(10).select("id", ordering.bin_of(F.col("id"), 10, 5).alias("b")).orderBy("id")
    assert [r["b"] for r in df.collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4, None]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_lookup_with_a_hot_key(spark, how):
    # One key has a third of the rows.
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("long").alias("k")
    )
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = facts.join(dim, "k", how)
    got = joins.split_lookup(facts, dim, "k", "id", how, share=0.01)
    assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=str) == sorted(
        map(tuple, want.select("id", "k", "v").collect()), key=str
    )
    counts = facts.groupBy("k").agg(F.count("id").alias("n"))
    hot = joins.hot_keys(counts, "k", "n", 0.01).collect()
    assert max(r["_splits"] for r in hot) >= 33
    assert len(hot) <= 100


def test_lookup_beyond_the_broadcast_limit(spark):
    docs = spark.createDataFrame(
        [(i, "the cat " * (i % 3 + 1) + f"w{i % 5}") for i in range(60)], "idx long, text string"
    )
    model = features.TfidfModel.fit(docs, 0.05)
    small = sorted(map(tuple, model.transform(docs, bias=True).collect()))
    model._bytes = 1 << 40
    large = sorted(map(tuple, model.transform(docs, bias=True).collect()))
    assert [r[:3] for r in small] == [r[:3] for r in large]
    assert np.allclose([r[3] for r in small], [r[3] for r in large])


def test_duplicate_titles(spark):
    rows = [(0, "t", "b0"), (1, "u", "b1"), (2, "t", "b2"), (3, None, "b3"), (4, None, "b4")]
    df = spark.createDataFrame(rows, "idx long, title string, body string")
    assert sorted(r["idx"] for r in dedup.dedup_by_title(df).collect()) == [0, 1, 3]
    test = spark.createDataFrame([(0, "t"), (1, "v"), (2, "t")], "test_idx long, title string")
    pairs = dedup.match_known(test, df)
    assert sorted(map(tuple, pairs.collect())) == [(0, 0), (2, 0)]


def test_merge(spark):
    test = spark.range(3).withColumnRenamed("id", "test_idx")
    known = spark.createDataFrame([(1, "known")], "test_idx long, tags string")
    predicted = spark.createDataFrame([(0, "p0"), (2, "p2")], "test_idx long, tags string")
    got = sorted(map(tuple, dedup.merge_answers(test, known, predicted).collect()))
    assert got == [(6034196, "p0"), (6034197, "known"), (6034198, "p2")]
    # Known and predicted answers are disjoint and cover everything: their union is the same.
    union = known.unionByName(predicted).select(F.col("test_idx") + 6034196, "tags")
    assert sorted(map(tuple, union.collect())) == got


def test_repeated_tag_counts_once(spark):
    df = spark.createDataFrame([(0, "x x y"), (1, "Y z")], "idx long, tags string")
    assert {r["tag"]: r["cnt"] for r in tagstats.tag_counts(df).collect()} == {"x": 1, "y": 2, "z": 1}
    rank = {r["tag"]: r["rank"] for r in tagstats.tag_rank(df).collect()}
    assert rank == {"y": 0, "z": 1, "x": 2}


def test_a_document_alone_and_in_bulk(spark):
    docs = spark.createDataFrame(
        [(0, "aa bb aa"), (1, "bb cc"), (2, ""), (3, "c# +")], "idx long, text string"
    )
    model = features.TfidfModel.fit(docs, 0.0)
    bulk = model.transform(docs)
    norms = bulk.groupBy("idx").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert {r["idx"] for r in norms} == {0, 1} and all(abs(r["n"] - 1) < 1e-12 for r in norms)
    alone = model.transform(docs.filter("idx = 0"))
    assert sorted(map(tuple, alone.collect())) == sorted(
        map(tuple, bulk.filter("idx = 0").collect())
    )
    assert {r["idx"] for r in model.transform(docs, bias=True).collect()} == {0, 1, 2, 3}
    vectors = features.to_vectors(bulk, model.terms.count())
    assert len(vectors.filter("idx = 0").first()["indices"]) == 4


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0, [0.5, 0.2]), (1, [0.6, 0.7])], "test_idx long, scores array<double>")
    got = {r["test_idx"]: r["tags"] for r in scoring.predict_tags(df, ["a", "b"]).collect()}
    assert got == {0: "", 1: "a b"}


def test_hash_is_the_stated_polynomial(spark):
    a, b, c, d = coefficients(15)
    for x, got in spark.range(0, 10**12, 10**11).select("id", cell_hash(F.col("id"), 15)).collect():
        x %= PRIME
        assert got == (((((a * x + b) % PRIME) * x + c) % PRIME) * x + d) % PRIME


@pytest.mark.parametrize("n, k", [(2500, 40), (400, 4000), (1, 5), (3, 7)])
def test_projection_density(spark, n, k):
    cells = projection.projection(spark.range(n).withColumnRenamed("id", "feature_id"), n, k)
    rows = cells.collect()
    assert len({(r["feature_id"], r["dim"]) for r in rows}) == len(rows)
    assert all(0 <= r["dim"] < k and 0 <= r["feature_id"] < n for r in rows)
    cells_of = lambda sign: sum(r["sign"] == sign for r in rows)
    expected = n * k / projection.draws(n)
    assert cells_of(1) + cells_of(-1) == len(rows)
    assert all(abs(cells_of(s) - expected) < 5 * expected**0.5 + 1 for s in (-1, 1))
    if n > 100:
        # Dimensions are hit alike, and a feature's number of cells is spread as it should be.
        hits = np.bincount([r["dim"] for r in rows], minlength=k)
        first, last = hits[: k // 2].sum(), hits[k // 2 :].sum()
        assert abs(first - last) < 5 * len(rows) ** 0.5
        per_feature = np.bincount([r["feature_id"] for r in rows], minlength=n)
        assert 0.7 < per_feature.var() / (per_feature.mean() * (1 - per_feature.mean() / k)) < 1.4


def test_noise(spark):
    noise = spark.range(20000).select(cell_normal(F.col("id"), 3).alias("z"))
    mean, dev = noise.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.05 and abs(dev - 1) < 0.05
