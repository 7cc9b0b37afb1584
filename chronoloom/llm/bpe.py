"""BPE encoding and decoding with a backtracking encoder.

Tables from the tokenizer file: for each token its two halves, for each mergeable pair the merged
token, and an Aho-Corasick automaton over all tokens that encode to themselves. A word is encoded
from the left: the longest token at the position is tried first, then ever shorter prefixes that
are tokens; a token may follow another only if the pair-compatibility test says that merging
would leave that boundary. If nothing fits, the last token is taken back and its position is
closed for good, so each position is tried at most once for each token that starts there. The
result equals that of the merge rules applied in their order.

Decoding gathers slices of one byte string by an offset table, one slice for each id.

Defined results: null and empty texts have no tokens; rows are coded one by one, so repeated rows
and null doc_ids keep a row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

END = "\0"  #: stands for the end-of-word suffix; byte-level texts never hold it
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed: white space as the tokenizers library's patterns have it.
SPACES = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class BacktrackingBPE:
    """A tokenizer file of kind BPE with byte-level words and an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # ranks: single symbols first, then tokens in the order of their merges
        made: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            made.setdefault(a + b, (a, b))
        order = [t for t in vocab if t not in made] + list(made)
        self.rank = {t: r for r, t in enumerate(order)}
        self.ids = [vocab[t] for t in order]
        self.length = [len(self._own(t)) for t in order]
        self.split = [(self.rank[made[t][0]], self.rank[made[t][1]]) if t in made else (r, r) for r, t in enumerate(order)]
        self.pair = {(self.rank[a], self.rank[b]): self.rank[a + b] for a, b in merges}
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(order)
        whole = {}
        for t, r in self.rank.items():
            if t not in made or self._stays(r):
                whole[self._own(t)] = r
        for text, r in whole.items():
            self.automaton.add_word(text, r)
        for text, r in whole.items():
            for n in range(len(text) - 1, 0, -1):
                if (p := whole.get(text[:n])) is not None:
                    self.shorter[r] = p
                    break
        self.automaton.make_automaton()
        self.letters = byte_letters()
        self.table = {i: c for i, c in enumerate(self.letters)}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.library = None
        self.path = path
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        # decoding: all token strings, each with the separator, in one byte string
        size = max([*vocab.values(), *self.added.values()]) + 1
        strings = [b""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            strings[i] = t.encode() + b" "
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def _own(self, token: str) -> str:
        s = self.suffix
        return token[: -len(s)] + END if s and token.endswith(s) and len(token) > len(s) else token

    def _stays(self, r: int) -> bool:
        """Whether a token's text encodes to the token: its halves do and meet at that boundary."""
        a, b = self.split[r]
        return self.compatible(a, b, r)

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether merging would leave the boundary between tokens a and b (below rank ``limit``)."""
        pair, split = self.pair, self.split
        while True:
            if (m := pair.get((a, b))) is not None and m < limit:
                return False
            if a > b:  # undo the later merge
                limit = a
                a = split[a][1]
                if a == limit:
                    limit = b + 1
                    b = split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = split[a][1]
                    if a == limit:
                        return True

    def encode_symbols(self, text: str) -> list[int]:
        """Ranks for a word in the vocabulary's letters, with END if words have an end."""
        n = len(text)
        longest = [-1] * (n + 1)
        length, shorter, fits, width = self.length, self.shorter, self.fits, len(self.length)
        for end, r in self.automaton.iter(text):
            start = end - length[r] + 1
            if longest[start] < 0 or length[r] > length[longest[start]]:
                longest[start] = r
        open_ = [True] * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n or not out:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if open_[end]:
                    if last < 0:
                        break
                    fit = fits.get(last * width + token)
                    if fit is None:
                        if len(fits) >= 400_000:
                            fits.clear()
                        fit = fits[last * width + token] = self.compatible(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                token = longest[pos]
            else:
                if not out:
                    raise ValueError(f"no tokens for {text!r}")
                open_[pos] = False
                token = out.pop()
                pos -= length[token]
        return out

    def word(self, w: str) -> tuple[int, ...]:
        got = self.cache.get(w)
        if got is None:
            symbols = w if w.isascii() else w.encode().decode("latin-1").translate(self.table)
            if w.isascii() and not w.isprintable():
                symbols = w.translate(self.table)
            ids = self.ids
            got = tuple([ids[r] for r in self.encode_symbols(symbols + END if self.suffix else symbols)])
            if len(self.cache) >= 300_000:
                self.cache.clear()
            if len(w) <= 64:
                self.cache[w] = got
        return got

    def words_of(self, part: str) -> list[str]:
        """Normalised words. Letters whose class or case depends on the Unicode version go through the library's own rules."""
        if part.isascii():
            return self.words.findall(part.lower())
        if max(part) < "\u0530":
            return self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer, pre_tokenizers

            t = Tokenizer.from_file(self.path)
            with open(self.path, encoding="utf-8") as f:
                split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
            from tokenizers import Regex

            self.library = t.normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        normalizer, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normalizer.normalize_str(part))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(self.specials.split(text)) if self.specials and any(s in text for s in self.added) else [(0, text)]:
            if i % 2:
                out.append(self.added[part])
                continue
            for w in self.words_of(part):
                out += self.cache.get(w) or self.word(w)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by one space, as UTF-8."""
        if not len(ids):
            return b""
        size = self.sizes[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.blob[at[:-1]].tobytes()


@functools.lru_cache(maxsize=2)
def coder_of(path: str) -> BacktrackingBPE:
    """Kept for the next task of the same Python worker."""
    return BacktrackingBPE(path)


def bpe_round(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number and digest of its ids and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array(coder.encode(text or ""), np.uint32)
                rows.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
