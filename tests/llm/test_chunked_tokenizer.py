"""Chunks that the tokenizer gets many at a time (finding 1 of round 3)."""

import random
import re

import public_tokenizers
import pyarrow as pa
import pytest

from tallyforge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, texts, **kwargs):
        self.strings += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kwargs)


@pytest.fixture(scope="module")
def whole():
    return packing.ChunkedTokenizer(PATH).tokenizer


def alike(chunked, whole, texts):
    got = chunked.encode(pa.array(texts, pa.string()))
    for text, ids, e in zip(texts, got, whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert list(ids) == e.ids, repr(text)


def test_new_words_are_not_encoded_one_by_one(whole):
    chunked, draw = packing.ChunkedTokenizer(PATH), random.Random(2)
    words = ["".join(draw.choices("abcdeéñöпр漢", k=9)) for _ in range(20000)]
    chunked.tokenizer = counted = Counted(whole)
    alike(chunked, whole, [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)])
    assert counted.strings < 100


def test_every_plain_letter_is_one_letter(whole):
    letters = [c for c in map(chr, range(0x10000)) if re.match("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), packing._LETTERS) + "]", c)]
    assert len(letters) > 21000
    for c in letters:
        assert len(whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(f"a{c}b{c}"))) == 1, c


def test_plain_and_other_chunks_in_one_text(whole):
    pieces = [*"aAsSéÉßçñΣσςАяёЁ漢字'’.,!<|>=\"`{ \n\t\v\x1c\x7f19²½ªµ×÷ßẞÅK", "\u0301", "\u0338", "\u3099", "\u00a0", "\u0085", "か", "각", "😀", "'s", "'LL", "'re", "''s", "<|endoftext|>", "<|EndOfText|>", "</w>"]
    draw = random.Random(3)
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 40))) for _ in range(4000)]
    alike(packing.ChunkedTokenizer(PATH), whole, [*texts, "", " ", "x" * 5000])


def test_forgotten_chunks_encode_alike(whole, monkeypatch):
    monkeypatch.setattr(packing, "_CACHED_CHUNKS", 60)
    chunked, draw = packing.ChunkedTokenizer(PATH), random.Random(4)
    for turn in range(60):
        alike(chunked, whole, [" ".join(draw.choices(["w" + "é.xy"[k % 4] * (k % 50) + str(k) for k in range(30 + 10 * turn)], k=40)) for _ in range(3)])
        assert len(chunked.rows) == len(chunked.counts) == len(chunked.again) <= 60 and chunked.counts.sum() == len(chunked.ids)
