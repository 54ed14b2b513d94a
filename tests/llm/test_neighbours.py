import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.llm import neighbours
from tagspark.llm.common import table
from tagspark.llm.neighbours import Descent, near_vectors
from tagspark.llm.queries import op11_neighbour_descent
from conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.93):
    """`(vec_id, n_links, component_id, kept)` by comparing all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    units = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None or not np.isfinite(c) for c in v) else np.array(v, float)
        units.append(None if x is None or not x.any() else x / np.linalg.norm(x))
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if a is None or b is None or len(a) != len(b) or rows[i][2] != rows[j][2]:
                continue
            if a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    names = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(
        repr((r[0], links[i], names[find(i)], r[0] is not None and r[0] == names[find(i)])) for i, r in enumerate(rows)
    )


def got(frame):
    return sorted(map(repr, map(tuple, frame.select("vec_id", "n_links", "component_id", "kept").collect())))


def groups(seed=2, d=24):
    """Sparse pairs, chains at the threshold, a dense group, a loose group, copies and scaled copies."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=d) for _ in range(300)]

    def beside(x, cosine):
        y = rng.normal(size=d)
        x = x / np.linalg.norm(x)
        y -= (y @ x) * x
        return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)

    for k in range(60):
        rows.append(beside(rows[k], rng.choice([0.97, 0.94, 0.932, 0.928, 0.9])))
    at = rows[100]
    for _ in range(25):
        at = beside(at, 0.94)
        rows.append(at)
    rows += [beside(rows[120], rng.uniform(0.985, 0.999)) for _ in range(150)]
    rows += [beside(rows[130], rng.uniform(0.95, 0.985)) for _ in range(60)]
    rows += [rows[140] * rng.choice([1, 1, 1, 2.5]) for _ in range(40)]
    return [(k, np.float32(x).tolist(), int(k % 3 if k < 300 else 0)) for k, x in enumerate(rows)]


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF, "embeddings").collect()]
    found = op11_neighbour_descent(spark, SF)
    assert dict(found.dtypes)["n_links"] == "bigint" and got(found) == plain(rows)


@pytest.mark.parametrize("settings", [Descent(), Descent(neighbours=3, reverse=2, orders=1, window=6, audited=500, recall=1.0)])
def test_groups(spark, settings):
    rows = groups()
    want = plain(rows)
    assert got(near_vectors(spark.createDataFrame(rows, SCHEMA), settings)) == want


def test_dense_groups_are_a_few_balls(spark):
    rows = spark.createDataFrame([r for r in groups()], SCHEMA)
    distinct = neighbours.distinct_vectors(neighbours.usable(rows))
    coded = neighbours.with_codes(distinct, [4, 8], 11)
    placed = neighbours.cover(coded, 2, np.arccos(0.93) / 2 - 1e-9)
    _, balls = neighbours.ball_table(coded, placed)
    assert distinct.count() - balls.count() > 100
    assert balls.agg(F.max("radius")).first()[0] <= np.arccos(0.93) / 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1),
        (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1),
        (12, [1.0, 0.1], 1), (12, [1.0, 0.1], 1), (None, [1.0, 0.1], 1), (None, None, None), (None, [0.0, 1.0], 3),
        (None, [0.0, 1.0], 3), (13, [1e-30, 0.0], 1), (14, [3e38, 3e38], 5), (15, [1e38, 1.01e38], 5),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash"))
    want = plain([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in rows])
    assert got(near_vectors(frame)) == want
    assert near_vectors(frame.limit(0)).count() == 0
    assert got(near_vectors(frame.filter("vec_id = 8"))) == ["(8, 0, 8, True)"]


def test_audit_sees_what_lists_lack(spark):
    rows = spark.createDataFrame(groups(), SCHEMA)
    distinct = neighbours.distinct_vectors(neighbours.usable(rows))
    coded = neighbours.with_codes(distinct, [4], 11)
    _, balls = neighbours.ball_table(coded, spark.createDataFrame([], "node long, ball long"))
    settings = Descent()
    none = spark.createDataFrame([], neighbours.PAIRS)
    share, links = neighbours.audit(balls, none, settings)
    assert share == 0 and links.count() > 1000
    assert neighbours.audit(balls, links, settings)[0] == 1
