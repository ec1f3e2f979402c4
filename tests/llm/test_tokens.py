import random

import public_tokenizers
import pytest

from wheelgraph.llm._tokens import Encoder

ODD = ["", "<|endoftext|> hi <|startoftext|>", "it's  we'll\n\n x   y", "日本語 テキスト", "  lead", "trail \n ", "a\t b \r\n c", "x" * 200 + " 12345 ½ ²", "Ω Σας ß ẞ İ", "é é   x   y", "“q” — it’s €5"]


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_equals_the_library(name, words, monkeypatch):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(" \n\t'sdmreltvXé1.,!-—ñÉ日") for _ in range(60)) for _ in range(300)]
    coder = Encoder(public_tokenizers.path(name), words)
    monkeypatch.setattr("wheelgraph.llm._tokens.SLICE", 40)
    coder.pieces.size = coder.chunks.size = 50
    for t in texts:
        assert coder.ids(t) == coder.whole(t), t
