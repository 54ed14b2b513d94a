import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagspark.llm.common import table
from tagspark.llm.packing import Capacities, best_fit, pack_documents, pack_pieces
from tagspark.llm.queries import op3_best_fit_packing
from tagspark.sources.staging import stage
from conftest import SF


def check(lengths, caps, sequence, offset):
    for s in set(sequence.tolist()):
        mine = np.flatnonzero(sequence == s)
        mine = mine[np.argsort(offset[mine])]
        assert len(mine) <= caps.documents
        assert (lengths[mine].astype(float) ** 2).sum() <= caps.attention
        assert offset[mine[0]] == 0 and lengths[mine].sum() <= caps.tokens
        assert (offset[mine][1:] == np.cumsum(lengths[mine])[:-1]).all()


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    lengths = np.sort(np.random.default_rng(3).integers(1, 101, 400))[::-1]
    for caps in (Capacities(100, 100, 1e4, score=score), Capacities(100, 3, 6e3, score=score)):
        if caps.attention < 1e4:
            lengths = lengths[lengths <= 77]
        sequence, offset = best_fit(lengths, caps)
        check(lengths, caps, sequence, offset)
    assert len(set(best_fit(np.array([60, 50, 50, 40]), Capacities(100, 9, 1e4))[0])) == 2
    with pytest.raises(ValueError):
        best_fit(np.array([101]), Capacities(100))


def test_documents(spark):
    rows = [(1, "a b " * 900, "x"), (2, None, None), (None, "c", "x"), (2, "", "y"), (1, "a b " * 900, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    file = public_tokenizers.path("word_bpe_49k.json")
    caps = Capacities(tokens=64, attention=64.0**2)
    got = pack_documents(docs, file, 0, caps).toPandas()
    tokens = sum(len(Tokenizer.from_file(file).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert got["length"].sum() == tokens and got["sequence_id"].nunique() == -(-tokens // 64)
    check(got["length"].to_numpy(), caps, got["sequence_id"].to_numpy(), got["offset"].to_numpy())
    assert pack_documents(docs.limit(0), file, 0).count() == 0


def test_pieces_equal_the_library(spark):
    """The whole result of the query, on whole texts."""
    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    got = op3_best_fit_packing(spark, SF).toPandas()
    want = []
    for r in table(spark, SF, "documents").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(want)
    check(got["length"].to_numpy(), Capacities(), got["sequence_id"].to_numpy(), got["offset"].to_numpy())
    assert got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 2048 + 1


def test_limits_that_bind(spark):
    """Few documents and little attention to a sequence, on the given texts."""
    caps = Capacities(tokens=2048, documents=3, attention=2048.0**2 / 2, group_tokens=10**7)
    file = public_tokenizers.path("word_bpe_49k.json")
    short = table(spark, SF, "documents").filter("length(text) < 3000")
    got = pack_documents(short, file, 0, caps).toPandas()
    check(got["length"].to_numpy(), caps, got["sequence_id"].to_numpy(), got["offset"].to_numpy())
    per = got.groupby("sequence_id")["length"].agg(["size", lambda x: (x.astype(float) ** 2).sum()])
    assert (per["size"] == 3).any()
    # One limit less gives fewer sequences, so each of the two does bind.
    for less in (Capacities(attention=caps.attention, group_tokens=10**7), Capacities(documents=3, group_tokens=10**7)):
        assert pack_documents(short, file, 0, less).select("sequence_id").distinct().count() <= len(per)


def test_one_id_is_packed_by_many_tasks(spark):
    rows = [(7 if k % 2 else None, 0, 100 + k % 50) for k in range(2000)]
    pieces = stage(spark.createDataFrame(rows, "doc_id long, piece int, length long"), "pieces")
    got = pack_pieces(pieces, Capacities(group_tokens=20_000)).toPandas()
    assert len(got) == 2000 and (got["sequence_id"].to_numpy() >> 32).max() >= 9
    check(got["length"].to_numpy(), Capacities(), got["sequence_id"].to_numpy(), got["offset"].to_numpy())
    groups = got.groupby(got["sequence_id"].to_numpy() >> 32)["length"].sum()
    assert len(groups) >= 10 and groups.max() < 2.5 * groups.mean()
