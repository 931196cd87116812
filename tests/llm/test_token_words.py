"""Words of the token-file encoder: those of Latin letters need not the whole tokenizer, and ids are the library's whatever the text."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")

from corpuslab.llm import token_file  # noqa: E402


@pytest.fixture(scope="module")
def encoder():
    return token_file.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def same(encoder, texts):
    """Whether encode gives the library's ids for each text."""
    ids, n = encoder.encode(texts)
    ends = np.cumsum(n)
    want = [encoder.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
    return [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want


class Counting:
    """A tokenizer that counts what is encoded by all of its steps."""

    def __init__(self, own):
        self.own, self.model, self.n = own, own.model, 0

    def encode_batch_fast(self, texts, **options):
        self.n += sum(any(x > "\x7f" for x in t) for t in texts)
        return self.own.encode_batch_fast(texts, **options)


def test_latin_words_are_known_once(encoder):
    """Capitals and punctuation make no further words of Latin letters, and the model alone encodes them."""
    encoder.forget()
    own, encoder.tokenizer = encoder.tokenizer, Counting(encoder.tokenizer)
    try:
        encoder.encode(pa.array(["réré réré, Réré. (réré) RÉRÉ", "straße; Straße! Àé à7é"]))
        assert encoder.tokenizer.n == 0
    finally:
        encoder.tokenizer = own
    assert sorted(x for x in encoder.words.to_pylist() if x and not x.isascii()) == ["ré" * 2, "straße", "à", "àé", "é"]


def test_capitals_make_no_special_token(encoder):
    """A word whose small letters would be a special token, beside that token, stays a word."""
    assert same(encoder, pa.array(["<|endoftext|> <|ENDOFTEXT|>", "É<|startoftext|>é, <|StartOfText|>x", "<|EndOfText|>"]))


def test_odd_texts(encoder):
    few = ("a", "S", "é", "É", "ß", "×", "ÿ", "İ", "Σ", "'", "'s", ".", "7", "²", "́", "̸", " ", "\x1c", " ", "\n", "漢", "<|endoftext|>")
    assert same(encoder, pa.array(["".join(x) for x in itertools.product(few, repeat=3)]))
    texts = pa.array(["cut off", None, "", " \n", " é", None, "a,̸é.b ", "cut off"])
    assert same(encoder, texts.slice(1, 6)) and same(encoder, texts.slice(1, 6).cast(pa.large_string())) and same(encoder, texts.slice(2, 2)) and same(encoder, texts.slice(0, 0))


def test_bits_of_any_width():
    """Blocks of any size and width come back, whole and in part."""
    r = np.random.default_rng(4)
    for w, block in itertools.product((0, 1, 7, 8, 15, 16, 17, 31, 32), (512, 64, 12, 7)):
        values = r.integers(0, 2**w, (5, block)).astype(np.uint32)
        packed = token_file.low_bits(values, w)
        assert packed.shape == (5, -(-block * w // 8))
        assert not w or np.array_equal(token_file.from_bits(packed, w, block), values)
        ids = np.append(values.ravel(), np.uint32(2**32 - 1))
        data = token_file.pack(ids, block)
        assert np.array_equal(token_file.unpack(data), ids) and np.array_equal(token_file.unpack(data, 1, 3), values[1:3].ravel())
