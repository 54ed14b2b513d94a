import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.llm.mixing import Mix, apply_mix, fly, land, mix_sources
from tagspark.sources.staging import stage


def filled(sizes, mix):
    """Targets by sharing again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(order)}
    target, rest, free = {}, mix.share * sum(sizes.values()), list(order)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > mix.most * sizes[s] + 1e-9]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = mix.most * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(4)
    sizes, chance = draw.integers(1, 50, 300).astype(float), draw.random(300)
    after = fly(sizes, chance, draw.random(300))
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert abs(after.sum() - chance.sum()) < 1e-6 and abs((after - chance) @ sizes) < 1e-4
    equal = fly(np.ones(50), np.full(50, 0.3), draw.random(50))
    assert abs(equal.sum() - 15) < 1e-6
    assert set(land(sizes, after)) <= {0.0, 1.0}


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, block):
    draw = np.random.default_rng(6)
    names = ["b", "a", None, "ä", "B", "c"]
    rows = [(i, "w " * int(draw.integers(0, 40)), names[int(draw.integers(0, 6)) if i % 3 else 0]) for i in range(900)]
    rows += [(1000, None, "empty"), (None, "x y", "a"), (5, "x y z", "a"), (5, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("_row", F.lit(1))
    mix = Mix(block=block)
    got = mix_sources(docs, mix).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = filled(sizes, mix)
    got["source"] = got["source"].where(got["source"].notna(), None)
    for source, mine in got.groupby(got["source"].fillna("<null>")):
        source = None if source == "<null>" else source
        assert (mine["source_size"] == sizes[source]).all()
        assert np.allclose(mine["target"], want[source])
        assert abs(mine["taken"].sum() - want[source]) <= max(5, 0.01 * want[source])
    assert got["copies"].between(0, 2).all() and (got["taken"] == got["copies"] * got["size"]).all()
    again = mix_sources(docs, mix).toPandas()
    key = ["doc_id", "source", "size", "copies"]
    assert sorted(map(repr, again[key].values)) == sorted(map(repr, got[key].values))


def test_apply_mix_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (None, "c", "s")], "doc_id long, text string, copies string")
    mixed = spark.createDataFrame([(1, 2), (2, 0), (None, 1)], "doc_id long, copies long")
    assert sorted(map(repr, map(tuple, apply_mix(docs, mixed).collect()))) == sorted(
        map(repr, [(1, "a", "s"), (1, "a", "s"), (None, "c", "s")])
    )
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).count() == 0


def test_one_id_is_mixed_in_many_blocks(spark):
    """All rows share an id and a size; each is taken on its own, and reruns agree."""
    docs = spark.createDataFrame([(7, "a b c", "x" if k % 4 else "y") for k in range(3000)], "doc_id long, text string, source string")
    docs = stage(docs, "one-id")
    mix = Mix(block=100)
    got = [tuple(r) for r in mix_sources(docs, mix).select("source", "size", "target", "copies", "taken").collect()]
    assert len(got) == 3000
    for source in "xy":
        mine = [r for r in got if r[0] == source]
        assert abs(sum(r[4] for r in mine) - mine[0][2]) <= 3 * 2 and len({r[3] for r in mine}) <= 2
    again = [tuple(r) for r in mix_sources(docs, mix).select("source", "size", "target", "copies", "taken").collect()]
    assert sorted(again) == sorted(got)
