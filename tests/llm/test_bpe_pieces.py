"""Each text is split once, and windows of few bytes are merged as a heap merges them."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
bpe = pytest.importorskip("quillmark.llm.bpe")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_short_windows_merge_as_by_the_heap(encoder, monkeypatch):
    rnd = random.Random(8)
    texts = [bytes(rnd.choice(b"aabcdeehinorst  \xc3\xa9") for _ in range(rnd.randrange(1, bpe.FEW + 3))) for _ in range(3000)]
    few = [encoder.merge(t) for t in texts]
    monkeypatch.setattr(bpe, "FEW", 0)
    assert few == [encoder.merge(t) for t in texts]
    monkeypatch.undo()
    assert all(encoder.part(t) == f for t, f in zip(texts, few))


def test_a_text_is_split_once(monkeypatch):
    own = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    seen, split = [], own.split
    own.split = lambda text: seen.append(text) or split(text)
    text = "new words  to\n split, wordu wordv\t wordw  " * 3
    ids = own.encode(text)
    assert seen == [text]
    assert b"".join(own.token[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4)) == text.encode()
