import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.queries import op12_spelling_variants
from tagspark.llm.spelling import FmIndex, Spelling, count_words, group_spellings, near_words, spelling_variants
from tagspark.sources.staging import stage
from conftest import SF


def plain_counts(rows, least=7, damaged=31, min_count=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % damaged == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts, ratio=10):
    near = {w: set() for w in counts}
    buckets = {}
    for w in counts:
        for v in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            buckets.setdefault(v, []).append(w)
    for members in buckets.values():
        for a in members:
            near[a] |= {b for b in members if distance_one(a, b)}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(map(repr, out))


def got(frame):
    return sorted(map(repr, map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect())))


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = plain_groups(plain_counts(rows))
    found = op12_spelling_variants(spark, SF)
    assert got(found) == want and sum(w.split(', ')[1] != 'None' for w in want) >= 5
    assert dict(found.dtypes)["n_near"] == "bigint"


def test_near_words_of_any_alphabet():
    draw = random.Random(4)
    for letters, n in (("ab", 200), ("abcdéÿ日🙂", 400)):
        words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(n)})
        indexed, asking = words[::2] + words[1::4], words
        index = FmIndex(indexed)
        pairs = set()
        for word in asking:
            for from_end in (False, True):
                here = index.mirrored() if from_end else index
                symbols, half = index.coded([word]).reshape(1, -1), len(word) // 2
                if from_end:
                    symbols, half = symbols[:, ::-1], len(word) - half
                _, number = near_words(here, symbols, half)
                pairs |= {(word, indexed[k]) for k in number}
        want = {(a, b) for a in asking for b in indexed if distance_one(a, b) and len(a) <= len(b)}
        assert pairs == want


def test_shared_halves_and_small_shards(spark):
    draw = random.Random(8)
    words = {"abcd" + "".join(draw.choice("xyz") for _ in range(4)) for _ in range(80)}
    words |= {"".join(draw.choice("pq") for _ in range(draw.randint(2, 9))) for _ in range(200)}
    counts = {w: draw.choice([2, 3, 20, 40, 400, 5000]) for w in words}
    frame = stage(spark.createDataFrame(sorted(counts.items()), "word string, n long"), "test-words")
    want = plain_groups(counts)
    for settings in (Spelling(), Spelling(shard_words=15)):
        assert got(group_spellings(frame, settings)) == want


def test_odd_rows(spark):
    long_ = "Überraschung naïveté STRASSE×÷ " * 60_000 + "x" * 70 + " " + "Ābcdefgh"
    rows = [(1, None), (2, ""), (3, long_), (3, long_[:500]), (None, "Überraschung ÀBCDEFGH àbcdefgh "), (5, "ÀBCDEFGH\x00àbcdefgh")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    want = plain_counts(rows)
    assert {r["word"]: r["n"] for r in count_words(frame).collect()} == want and "x" * 70 not in want
    assert got(spelling_variants(frame)) == plain_groups(want)
    assert spelling_variants(frame.limit(0)).count() == 0
    many = [(k, "wordwords") for k in range(500)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in count_words(frame).collect()} == plain_counts(many)
