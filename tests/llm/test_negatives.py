import numpy as np
from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.negatives import Mining, hard_negatives, quantised, threshold_pairs
from tagspark.llm.queries import op13_hard_negatives
from conftest import SF


def plain(rows, is_anchor, positives=5, negatives=5, least=80):
    """`rows` are (vec_id, label, vector)."""
    out = []
    order = lambda s, k: (-s, rows[k][0] is None, rows[k][0] or 0)

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a, (anchor_id, label, vector) in enumerate(rows):
        if not is_anchor(anchor_id):
            continue
        scores = [dot(vector, v) for _, _, v in rows]
        same = sorted((k for k in range(len(rows)) if k != a and rows[k][1] == label), key=lambda k: order(scores[k], k))
        for p in same[:positives]:
            other = [
                k for k in range(len(rows))
                if rows[k][1] != label and least * scores[p] <= 100 * scores[k] <= 100 * scores[p]
            ]
            for rank, k in enumerate(sorted(other, key=lambda k: order(scores[k], k))[:negatives], 1):
                out.append((anchor_id, rows[p][0], rank, rows[k][0], scores[p], scores[k]))
    return sorted(map(repr, out))


def got(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_whole_table(spark):
    rows = []
    for r in table(spark, SF, "embeddings").collect():
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], label, [int(np.floor(256 * x)) for x in r["embedding"]]))
    found = op13_hard_negatives(spark, SF)
    assert found.columns[:6] == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    assert dict(found.dtypes)["rank"] == "int" and dict(found.dtypes)["negative_score"] == "bigint"
    want = plain(rows, lambda i: i % 100 == 0)
    assert want and got(found) == want


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 6, size=(12, 4)).tolist()
    rows = [(k, k % 3, base[k % 12]) for k in range(90)]
    rows += [(200 + k, 1, base[0]) for k in range(30)] + [(300 + k, 2, base[0]) for k in range(30)]
    rows += [(None, 1, base[2]), (None, 0, base[3]), (None, 0, base[3]), (10, 1, base[0]), (10, 1, base[0])]
    rows += [(400, 1, []), (410, 1, [5, 5]), (420, 2, [0, 0, 0, 0]), (430, 2, [2, 1, 0, 3, 9])]
    schema = "vec_id long, label int, vector array<int>"
    frame = spark.createDataFrame(rows, schema)
    anchor = F.col("vec_id") % 10 == 0
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    for settings in (Mining(), Mining(block_rows=16, chunk_anchors=3, steps=())):
        assert got(hard_negatives(frame, anchor, settings)) == want
    few = Mining(positives=2, negatives=3, least_percent=50, block_rows=40)
    assert got(hard_negatives(frame, anchor, few)) == plain(rows, lambda i: i is not None and i % 10 == 0, 2, 3, 50)
    assert hard_negatives(frame.limit(0), anchor).count() == 0
    assert hard_negatives(frame.filter("vec_id = 10"), anchor).count() == 0
    assert hard_negatives(frame, F.lit(None).cast("boolean")).count() == 0


def test_rows_that_take_no_part(spark):
    rows = [
        (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [float("inf")]),
        (6, 1, [1e30]), (7, 1, [-0.001, 0.5]), (8, 1, []),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    kept = quantised(frame.withColumn("vector", F.lit("clash")), 256).orderBy("vec_id").collect()
    assert [tuple(r) for r in kept] == [(7, 1, [-1, 128]), (8, 1, [])]


def test_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    for scale in (4, 200, 2**29):
        q = rng.integers(-scale, scale, size=(20, 37)).astype(float)
        x = rng.integers(-scale, scale, size=(300, 37)).astype(float)
        x[:40] = q[rng.integers(0, 20, 40)]
        wanted = rng.random((20, 300)) < 0.8
        exact = q.astype(np.int64) @ x.astype(np.int64).T
        for share in (0.9, 0.5, 0.1, -2.0):
            t = np.floor(share * (q * q).sum(1))
            i, k, score = threshold_pairs(q, t, x, wanted)
            want = {(a, b, exact[a, b]) for a, b in zip(*np.nonzero(wanted & (exact >= t[:, None])))}
            assert set(zip(i, k, score)) == want and len(i) == len(want)
