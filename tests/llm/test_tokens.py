import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tagspark.llm.tokens import Encoder, TokenFile, chunk_levels, file_bytes, write_token_files, crc_of_ids

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: Encoder(public_tokenizers.path(f)) for f in FILES}
PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
PARTS = [
    "the", "Étage", "größe,", "it's", "x.", "A1b2", "  ", " ", "\n", "\n\n", "\t", "\r\n", "\x00", "\x1c", " ",
    "　", "́", "<|endoftext|>", "日本", "ﬁ", "İ", "Σας", "🙂", "'re", "...", "a,", ",", ".", "Å", " ", "\x85",
]


def both(name, text):
    want = PLAIN[name].encode(text, add_special_tokens=False).ids
    got = np.frombuffer(ENCODERS[name].encode([text])[0], "<u4").tolist()
    assert got == want, text


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_whole_text(name):
    draw = random.Random(5)
    for _ in range(4000):
        both(name, "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12))))
        both(name, " ".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12))))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_of_any_text(text):
    for name in FILES:
        both(name, text)


@pytest.mark.parametrize("high", [2, 256, 257, 50_257, 2**32])
def test_random_access(high):
    ids = np.random.default_rng(1).integers(0, high, 5_000, dtype=np.uint64).astype("<u4")
    data = file_bytes([7, None, 9], [ids[:10].tobytes(), b"", ids[10:].tobytes()])
    file = TokenFile(data)
    assert file.n_tokens == 5_000 and file.known.tolist() == [1, 0, 1]
    assert (file.document(0) == ids[:10]).all() and (file.document(2) == ids[10:]).all()
    assert len(file.document(1)) == 0
    at = np.random.default_rng(2).permutation(5_000)[:60]
    assert (file.tokens(at) == ids[at]).all()
    assert [file.token(i) for i in (0, 511, 512, 513, 4_999)] == ids[[0, 511, 512, 513, 4_999]].tolist()


def test_levels_of_no_ids():
    assert len(chunk_levels(np.array([], np.uint32))) == 1


def test_files_in_order(spark):
    rows = [(5, "b c"), (None, "x"), (2, None), (2, ""), (9, "word " * 5_000), (5, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", docs_lit())
    name = FILES[0]
    files = write_token_files(docs, public_tokenizers.path(name), 2, tokens_per_file=6)
    got = sorted(map(tuple, files.documents(crc_of_ids, "crc long").collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for doc_id, text in order:
        ids = PLAIN[name].encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), crc_of_ids(np.array(ids))[0]))
        start += len(ids)
    assert got == want
    empty = write_token_files(docs.limit(0), public_tokenizers.path(name), 2)
    assert empty.documents(crc_of_ids, "crc long").collect() == []


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
