"""Ids and spans of odd texts equal those of the library's plain call on the whole text."""

import random

import pytest
from tokenizers import Tokenizer

from voltaloom.llm import tokens
from voltaloom.llm.queries import tokenizer

# Parts of awkward texts.
PARTS = (
    [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x00", "\x01", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", "　", "​", "‍"]
    + ["a", "B", "word", "Word", "don't", "'s", "'t", "'S", "'", '"', ".", ",", "!?", "_", "(", "x", "1", "22", "٣", " ."]
    + ["İ", "GEÇMİŞİ", "̇", "́", "é", "é", "日本", "한", "하", "ﬁ", "ß", "ſ", "K", "ͅ", "\U0001f600"]
    + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_texts(name):
    rng, enc, plain = random.Random(17), tokens.Encoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    assert enc.kind != "whole"
    enc.ids.limit = enc.spans.limit = 5000  # so that generations pass
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["", " ", "\n", "\n\n", "x" * 5000]
    for lo in range(0, len(texts), 128):
        some = texts[lo : lo + 128]
        for t, ids, (a, b) in zip(some, enc.encode(some), enc.offsets(some), strict=True):
            e = plain.encode(t, add_special_tokens=False)
            assert e.ids == ids.tolist() and e.offsets == list(zip(a.tolist(), b.tolist(), strict=True)), repr(t)
