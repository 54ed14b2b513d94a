import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagspark.llm import simhash
from tagspark.llm.common import table
from tagspark.llm.simhash import components, fingerprint, forest, keep_one, links, near_duplicates, segments
from conftest import SF


def plain(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, distance=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    array = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(fps))]


def test_segments():
    for distance in range(0, 9):
        cut = segments(distance)
        assert sum(b for _, b in cut) == 64 and 2 * len(cut) > distance


def test_fingerprints():
    for text in (None, "", " \n", "One", "a b c", "A b\tc\x0bd", "Éa Éb É c d\x1ce f", "x " * 300):
        assert fingerprint(text, 4) == plain(text)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    rows += [(5000, None), (5001, ""), (5002, " "), (None, rows[3][1]), (rows[4][0], rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(map(repr, map(tuple, near_duplicates(docs).collect())))
    fps = [plain(t) for _, t in rows]
    named = classes([i for i, _ in rows], fps)
    assert got == sorted(repr((i, f"{fp:016x}", c)) for (i, _), fp, c in zip(rows, fps, named))


@pytest.mark.parametrize("block", [20_000, 6])
def test_links_lose_nothing(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(9)
    fps = {draw.getrandbits(64) for _ in range(40)}
    for fp in list(fps):
        for _ in range(draw.choice([0, 0, 5, 30])):
            for b in draw.sample(range(64), draw.randint(1, 4)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    found = components(links(spark.createDataFrame(signed, "fp long"), 4)).collect()
    label = {r["node"]: r["root"] for r in found}
    mine = [label.get(s, s) for s, in signed]
    want = classes([s for s, in signed], fps)
    assert mine == want


def unrelated_in_one_segment(n):
    """Fingerprints with the same low 22 bits, a tenth of them with a neighbour at up to 4 bits."""
    draw = random.Random(4)
    fps = {draw.getrandbits(42) << 22 | 12345 for _ in range(n)}
    for fp in sorted(fps)[: n // 10]:
        for b in draw.sample(range(64), draw.randint(1, 4)):
            fp ^= 1 << b
        fps.add(fp)
    return sorted(fps)


def test_large_keys_are_cut_again(spark, monkeypatch):
    """All fingerprints share keys; inside these, comparisons stay few and no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 50)
    fps = unrelated_in_one_segment(1500)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    table_ = spark.createDataFrame([(s,) for s in signed], "fp long")
    large = simhash.large_keys(table_, 4)
    assert large.count() >= 20
    keyed = simhash.keys_of(table_, 4)

    def pairs(keys):
        return keys.groupBy("key").agg(F.countDistinct("fp").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]

    # Of two unrelated ones that share the 21 outer keys, one in 2^13 shares each of 43 inner ones.
    assert pairs(simhash.refined(keyed, large, table_, 4)) < pairs(keyed) / 100
    label = {r["node"]: r["root"] for r in components(links(table_, 4)).collect()}
    assert [label.get(s, s) for s in signed] == classes(signed, fps)


@pytest.mark.parametrize("distance", range(0, 9))
def test_near_fingerprints_share_an_inner_key(spark, distance):
    """Two fingerprints within reach and in a shared key share a key inside it as well."""
    draw = random.Random(distance)
    for first, bits in segments(distance):
        rest = simhash.rest_segments(first, bits, distance)
        assert sum(n for _, n, _ in rest) == 64 - bits
        rows = []
        for _ in range(20):
            x = draw.getrandbits(64)
            y = x
            for b in draw.sample([b for b in range(64) if not first <= b < first + bits] or [0], min(distance, 64 - bits)):
                y ^= 1 << b
            rows.append(tuple(int(np.uint64(v).astype(np.int64)) for v in (x, y)))
        pairs = spark.createDataFrame(rows, "x long, y long")
        if not rest:
            continue
        differ = [
            F.bit_count(F.expr(v.replace("fp", "x")).bitwiseXOR(F.expr(v.replace("fp", "y")))) for _, _, v in rest
        ]
        least = F.least(*differ) if len(differ) > 1 else differ[0]
        assert pairs.filter(least > 1).count() == 0


def test_forest_joins_a_chain():
    chain = np.array([(1 << k) - 1 for k in range(0, 60, 4)], np.uint64)
    assert sum(len(a) for a, _ in forest(chain, 4)) == len(chain) - 1


def test_keep_one_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "q r s t u"), (None, "z")], "doc_id long, text string")
    kept = keep_one(docs, near_duplicates(docs)).collect()
    assert sorted(map(repr, (r["doc_id"] for r in kept))) == sorted(map(repr, [1, 3, None]))
    assert near_duplicates(docs.limit(0)).count() == 0
