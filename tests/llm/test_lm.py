import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagspark.llm.common import table
from tagspark.llm.gru import Gru, Shape
from tagspark.llm.lm import Settings, lm_scores
from tagspark.llm.queries import op7_recurrent_scores
from conftest import SF


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def plain(rows):
    """Per row (n_tokens, n_known, base score), and the training tokens."""
    c = Counter(t for _, held, text in rows if not held for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for _, held, text in rows:
        mine = tokens(text)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in mine)
        out.append((len(mine), sum(c[t] > 0 for t in mine), base))
    return out, n


def small(rows=40, seed=2):
    draw = np.random.default_rng(seed)
    model = Gru.start(draw.integers(1, 50, rows).astype(float), Shape(rows, rows - 1, hidden=5, classes=4, window=4, lanes=3))
    for k, v in model.params.items():
        model.params[k] = (v + draw.normal(0, 0.2, v.shape)).astype(np.float64)
    return model, draw


def test_output_is_a_distribution():
    model, draw = small()
    h = draw.normal(size=(1, 5))
    scores, _ = model.output(np.repeat(h, 40, 0), np.arange(40))
    assert abs(np.exp(scores).sum() - 1) < 1e-6


def test_gradients_are_the_slopes():
    model, draw = small()
    x, y = draw.integers(0, 40, (4, 3)), draw.integers(0, 40, (4, 3))
    h = draw.normal(size=(3, 5))
    _, grads, _ = model.gradients(x, y, h)
    for name, grad in grads.items():
        if isinstance(grad, tuple):
            dense = np.zeros_like(model.params[name])
            dense[grad[0]] = grad[1]
            grad = dense
        flat, slope = model.params[name].reshape(-1), grad.reshape(-1)
        for k in draw.choice(flat.size, 6):
            old, values = flat[k], []
            for step in (1e-4, -1e-4):
                flat[k] = old + step
                values.append(-model.gradients(x, y, h)[0])
            flat[k] = old
            assert abs((values[0] - values[1]) / 2e-4 - slope[k]) < 2e-3 * max(1, abs(slope[k])), name


def test_state_is_carried_through_whole_documents():
    model, draw = small()
    docs = [np.append(draw.integers(0, 39, n), 39) for n in (0, 3, 17, 4, 50, 1, 9)]
    got = model.score(np.concatenate(docs), np.cumsum([len(d) for d in docs]))
    for d, value in zip(docs, got):
        x = np.append(39, d[:-1])[:, None]
        hidden, _, _ = model.states(x, np.zeros((1, 5), np.float32))
        assert abs(model.output(hidden[:, 0], d)[0].sum() - value) < 1e-3


def test_training_learns():
    draw = np.random.default_rng(1)
    text = np.tile([0, 1, 2, 3, 4, 5], 4_000)
    model = Gru.start(np.bincount(text, minlength=7).astype(float), Shape(7, 6, lanes=16))
    docs = np.append(text, 6)
    before = model.score(docs, np.array([len(docs)]))[0]
    model.train(docs)
    assert model.score(docs, np.array([len(docs)]))[0] > before / 3 and draw is not None


@pytest.mark.parametrize("shipped", [200_000, 5])
def test_base_scores(spark, shipped):
    rows = [(k, k % 3 == 0, f"The the cat{k % 5} sat\x0bon É\x1cx {'far ' * (k % 4)}") for k in range(40)]
    rows += [(100, True, None), (101, False, ""), (None, True, "never seen words"), (5, False, "x " * 3_000), (5, False, "x " * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").withColumn("n_tokens", F.lit("clash"))
    got = lm_scores(docs, Settings(shipped=shipped, known=3)).collect()
    want, n = plain(rows)
    assert all(r["train_tokens"] == n for r in got)
    key = lambda r: (repr(r[0]), r[1:4])
    mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    brute = sorted(((i, h, *w) for (i, h, _), w in zip(rows, want)), key=key)
    assert [m[:4] for m in mine] == [b[:4] for b in brute]
    assert np.allclose([m[4] for m in mine], [b[4] for b in brute])
    assert all(r["score"] < 0 for r in got)
    assert lm_scores(docs.limit(0)).count() == 0
    alone = lm_scores(docs.filter("doc_id = 0")).collect()
    assert alone[0]["n_known"] == 0 and alone[0]["base_score"] == 0


def test_held_out_gain(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    got = op7_recurrent_scores(spark, SF).collect()
    rows = [(i, zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in docs.items()]
    want, _ = plain(rows)
    base = {i: (h, *w) for (i, h, _), w in zip(rows, want)}
    for r in got:
        held, n, known, score = base[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held, n, known)
        assert abs(r["base_score"] - score) < 1e-6 * abs(score)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    )
    gains = {}
    for learner_tokens in (500_000, 2_000):
        for n in (1, 4, 32):
            found = lm_scores(docs.repartition(n), Settings(learner_tokens=learner_tokens)).filter("held_out")
            gains[learner_tokens, n] = found.agg(F.sum(F.col("score") - F.col("base_score"))).first()[0]
    for learner_tokens in (500_000, 2_000):
        some = [gains[learner_tokens, n] for n in (1, 4, 32)]
        assert max(some) - min(some) < 0.01 * max(some)
    assert min(gains[500_000, n] for n in (1, 4, 32)) > 8_000
