"""The word tables of op5 and op10 stay bounded in bytes."""

import random
import resource

import numpy as np
import public_tokenizers
import pytest

from civicspark.llm import packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def cjk(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def expected(whole, texts):
    return [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]


def test_packing_table_forgets_words_without_spaces(whole):
    words = packing.Words(PATH, 2)
    words.encode(["plain words first, of course."])
    size, room = len(words.index), words.ids.n
    for k in range(4):
        texts = [*cjk(20, 300, k), "words, again words first"]
        assert words.encode(texts)[0].tolist() == expected(whole, texts)
    assert len(words.index) <= size + 4 and words.ids.n < room + 20  # "words,", "again" and "first" are kept
    assert len(words.index) + 1 == words.size.n == words.start.n == words.stop.n  # the end of a document has no word


def test_packing_table_starts_again_beyond_its_bytes(whole, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 20_000)
    words, most = packing.Words(PATH, 2), 0
    for k in range(30):
        texts = [" ".join(f"w{k}x{i}" for i in range(40)), "same words each time, same."]
        assert words.encode(texts)[0].tolist() == expected(whole, texts)
        most = max(most, words.held)
    assert most < 30_000


def test_packing_memory_on_unspaced_texts():
    words = packing.Words(PATH, 2)
    rows = cjk(50, 3000)
    words.encode(rows)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(20):
        words.encode([t[k:] + t[:k] for t in rows])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB; 1,000 texts of 3,000 characters
    assert np.all(np.diff(words.start.room[:words.start.n]) >= 0)


def test_length_table_is_bounded_in_bytes(monkeypatch):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, lengths = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Lengths(path)
    monkeypatch.setattr(token_counts, "KNOWN_BYTES", 20_000)
    most = 0
    for k in range(30):
        texts = [*cjk(5, 400, k), " ".join(f"w{k}x{i}" for i in range(40)), "same words each time"]
        assert lengths.of(texts) == [len(model.encode(t)) for t in texts]
        most = max(most, lengths.held)
        assert all(len(p) <= token_counts.LONG for p in lengths.known)
    assert most < 30_000


def test_length_memory_on_unspaced_texts():
    lengths, rows = token_counts.Lengths(public_tokenizers.path("piece_bpe_32k.model")), cjk(50, 3000)
    lengths.of(rows)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for k in range(400):  # 20,000 texts
        lengths.of([t[k:] + t[:k] for t in rows])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
