"""The fast encoders give the library's ids."""

import random

import pytest
from tokenizers import Tokenizer

from chronoloom.llm.encoders import ByteEncoder, WordEncoder, load_encoder
from chronoloom.llm.registry import byte_bpe, word_bpe


@pytest.mark.parametrize("path,kind", [(word_bpe(), WordEncoder), (byte_bpe(), ByteEncoder)])
def test_same_ids(path, kind):
    encode, t, rng = load_encoder(path), Tokenizer.from_file(path), random.Random(8)
    assert isinstance(encode, kind)
    texts = ["".join(rng.choice("abcdefgthein'sé日🙂İΣ 12\t\n\0.#*ñÄß  ") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 30))) for _ in range(5000)] + ["a<|endoftext|> b<|startoftext|>", "x" * 3000, " \n\n  y"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text
