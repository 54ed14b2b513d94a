import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tagspark.llm import tokens
from tagspark.llm.tokens import MARKS, Encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, texts):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    return [x.ids for x in found]


def encoded(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


@pytest.mark.parametrize("name", FILES)
def test_only_unusual_pieces_go_to_the_library(monkeypatch, name):
    encoder = Encoder(public_tokenizers.path(name))
    sent, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda pieces: sent.extend(pieces) or ids(pieces))
    texts = ["Un mot&&& suivant\nLigne Étage### un  deux trois.", "Un mot&&& 555-5580, trois.###"]
    assert encoded(encoder, texts) == plain(name, texts)
    # First words, runs of marks, what is not letters, and the words on both sides of a run of spaces.
    assert sorted(sent) == sorted(["Un", "Un", "&&&", "###", ".", ".###", " 555-5580,", " un  deux"])
    sent.clear()
    assert encoded(encoder, texts) == plain(name, texts)
    assert sorted(sent) == sorted(["Un", "Un", " un  deux"])


@pytest.mark.parametrize("name", FILES)
def test_marks_and_line_ends(monkeypatch, name):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    encoder = Encoder(public_tokenizers.path(name))
    draw = random.Random(8)
    letters = ["the", "Étage", "größe", "STRASSE", "µm", "ªº", "ÿ", "ß", "Ж", "日本", "1a", "é", ""]
    marks = [*MARKS, "'", "'s", "&&&", "...", "<|", "|>", "<|endoftext|>", "", "", ""]

    def word():
        return draw.choice(letters) + "".join(draw.choice(marks) for _ in range(draw.randint(0, 3)))

    for _ in range(60):
        texts = []
        for _ in range(draw.randint(0, 12)):
            words = [word() + draw.choice([" ", " ", " ", "\n", "  ", "\n\n", "\t "]) for _ in range(draw.randint(0, 30))]
            texts.append("".join(words).rstrip(draw.choice(["", " \n"])) + draw.choice(["", "", "", "\x00 a  b"]))
        assert encoded(encoder, texts) == plain(name, texts)


def test_rows_are_taken_by_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_AT_ONCE", 40)
    sizes, encode = [], Encoder.encode
    monkeypatch.setattr(Encoder, "encode", lambda self, texts: sizes.append(len(texts)) or encode(self, texts))
    texts = ["a"] * 30 + [None, "", "b " * 100, None, "c"]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    path = public_tokenizers.path(FILES[0])
    rows = list(tokens.encoded_rows(iter([batch.slice(0, 0), batch, batch.slice(3)]), path, 2))
    want = [x + [2] for x in plain(FILES[0], [t or "" for t in texts])]
    assert [np.frombuffer(x, "<u4").tolist() for _, x in rows] == want + want[3:]
    assert [i for i, _ in rows] == [*range(35), *range(3, 35)]
    assert sum(sizes) == 35 + 32 and max(sizes) <= 40 and len(sizes) > 3
