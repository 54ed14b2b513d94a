import numpy as np
import pytest

from tagspark.llm import tokens


@pytest.mark.parametrize("at_once", [1, 40, 1 << 18])
def test_documents_are_read_in_spans(monkeypatch, at_once):
    monkeypatch.setattr(tokens, "TOKENS_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    sizes = [0, 5, 0, 0, 70, 1, 30, 600, 0]
    ids = [rng.integers(0, 50_000, n).astype("<u4") for n in sizes]
    file = tokens.TokenFile(tokens.file_bytes(list(range(len(ids))), [x.tobytes() for x in ids]))
    spans, span = [], file.span
    monkeypatch.setattr(file, "span", lambda a, b: spans.append((a, b)) or span(a, b))
    read = list(file.documents())
    assert len(read) == len(ids) and all((a == b).all() and len(a) == len(b) for a, b in zip(read, ids))
    assert len(spans) < len(ids) or at_once == 1
    empty = tokens.TokenFile(tokens.file_bytes([], []))
    assert list(empty.documents()) == []
