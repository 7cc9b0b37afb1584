"""Fast encoders that give the tokenizers library's ids for a tokenizer file.

The library's own merge loop takes most of the time on texts with many rare words. If every token of the file
encodes to itself and ranks rise with the merges, merging whatever adjacent pair forms the lowest-ranked token gives the same
ids: the symbols inside a token can only have come from merges inside it, which go as in the token alone. Two
shapes of file are recognised and merged with tiktoken's core; for any other, and for texts
with letters whose class differs between Unicode versions, the library itself encodes.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import numpy as np

from chronoloom.llm.bpe import END, BacktrackingBPE, byte_letters

#: From here on letter classes are left to the library.
PLAIN_BELOW = "԰"
#: Fixed: how byte-level files without a pattern of their own split texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def library_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


class WordEncoder(BacktrackingBPE):
    """Words with an end suffix; the ids of frequent words are kept as bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path)
        byte_of = {c: b for b, c in enumerate(self.letters)}
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 0]): 256 + b for b in range(1, 256)}
        self.id_of_rank = [b""] * (512 + len(self.rank))
        for token, r in self.rank.items():
            text = self._own(token)
            data = bytes(0 if c == END else byte_of[c] for c in text)
            k = ranks.setdefault(data, 512 + r)
            self.id_of_rank[k] = self.ids[r].to_bytes(4, "little")
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}
        self.exact = len(self.automaton) == len(self.rank)

    def data(self, w: str) -> bytes:
        got = self.kept.get(w)
        if got is None:
            raw = w.encode()
            if 0 in raw or not self.exact:
                got = np.array(self.word(w), "<u4").tobytes()
            else:
                ids = self.id_of_rank
                got = b"".join([ids[r] for r in self.core._encode_single_piece(raw + b"\0")])
            if len(self.kept) >= 300_000:
                self.kept.clear()
            if len(w) <= 64:
                self.kept[w] = got
        return got

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, kept, data = [], self.kept, self.data
        for text in texts:
            if self.specials and any(s in text for s in self.added):
                out.append(np.array(self.encode(text), np.uint32))
            else:
                out.append(np.frombuffer(b"".join([kept.get(w) or data(w) for w in self.words_of(text)]), "<u4"))
        return out


class ByteEncoder:
    """Byte-level files without a suffix."""

    def __init__(self, path: str, spec: dict) -> None:
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.core = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
        self.path, self.library = path, None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if text.isascii() or max(text) < PLAIN_BELOW:
                out.append(self.core.encode_to_numpy(text, allowed_special="all"))
            else:
                self.library = self.library or library_encoder(self.path)
                out += self.library([text])
        return out


def _ranks_are_ids(spec: dict) -> bool:
    """Whether ids rise in the order of the merges and every merge makes a token of its own from earlier ones."""
    model, made = spec["model"], set()
    last = 255
    for m in model["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        i = model["vocab"][a + b]
        if i <= last or a + b in made or max(model["vocab"][a], model["vocab"][b]) >= i:
            return False
        made.add(a + b)
        last = i
    return len(model["vocab"]) == 256 + len(made)


@functools.lru_cache(maxsize=4)
def load_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to arrays of ids, without special tokens added; kept for the next task of a Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model.get("type") != "BPE" or any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return library_encoder(path)
    if model.get("end_of_word_suffix") and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return WordEncoder(path)
    pre = spec["pre_tokenizer"] or {}
    if not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix") and _ranks_are_ids(spec):
        return ByteEncoder(path, spec)
    return library_encoder(path)
