"""Word tokens of the packer against the tokenizer itself."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textweir.llm import packing


@pytest.mark.parametrize("remembered", [400, 400_000])
def test_pieces_have_the_ids_of_the_tokenizer(monkeypatch, remembered):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words, rng = Tokenizer.from_file(path), packing.WordTokens(path), random.Random(remembered)

    def text():
        return "".join(chr(rng.choice([
            rng.randint(32, 126), rng.randint(97, 122), rng.randint(65, 90), rng.randint(48, 57), 39, 32, rng.randint(0, 0x24F),
            rng.randint(0xC0, 0x24F), rng.randint(0x370, 0x3FF), rng.randint(0x300, 0x36F), rng.randint(0x3000, 0x9FFF),
            rng.randint(9, 13)])) for _ in range(rng.randint(0, 40)))

    texts = [None, "", " ", "Don't STOP't 's ('s) it's1's", "ΑΣ abcΣ", "ÁB́", "x\x1cy\x85z\xa0w", "MJ̌", "İx İ",
             "a×b÷c", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>", "1234 a1b22 !!a!!", "été's naïve,ÉTÉ.", "x" * 5_000]
    for _ in range(3):
        texts += [text() for _ in range(1_500)]
        ids, bounds = words(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [0]
    assert len(words.known) <= max(remembered, 20_000)


def test_a_tokenizer_without_word_ends_cuts_at_white_space():
    # its pieces depend on the white space before them: the packer states what it is exact for
    words = packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert not words.cuts and not words.folds
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, _ = words(pa.array(["Word12,"]))
    assert ids.tolist() == plain.encode("Word12,", add_special_tokens=False).ids + [0]
