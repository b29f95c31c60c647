"""Pre-tokens and ids of the byte-level tokenizer.

The tokenizer splits a text at its special strings first, then by one pattern; its merges never cross those cuts. So the
ids of a text are the ids of its pre-tokens end to end, and every distinct pre-token need be encoded only once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

#: Fixed value: the pattern by which byte-level tokenizers of this kind split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


class Pretokenizer:
    """Splits texts into pre-tokens; special strings stay whole and are told apart by their place in `specials`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.split = regex.compile(PATTERN).findall
        self.at_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None

    def pieces(self, text: str) -> list[str]:
        if not any(s in text for s in self.specials):
            return self.split(text)
        out: list[str] = []
        for part in self.at_specials(text):
            if part in self.specials:
                out.append(part)
            else:
                out += self.split(part)
        return out

    def count(self, pretokens: list[str]) -> list[int]:
        """The number of ids of each pre-token."""
        return [len(x.ids) for x in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


class Encoder:
    """The ids that the tokenizer file gives a text, by the faster of two libraries; both give the same ids.

    The library of the file itself takes 3 to 4 times the time. The other one merges by rank, and in this file the id of a
    piece is its rank; texts with a run of over `LONG_RUN` characters without white space, on which it takes quadratic time,
    go to the library of the file.
    """

    LONG_RUN = 2000

    def __init__(self, path: str):
        import tiktoken

        self.pre = Pretokenizer(path)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in self.pre.tokenizer.get_vocab(with_added_tokens=False).items() if piece not in self.pre.specials}
        self.fast = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.pre.specials)
        self.long_run = regex.compile(r"\S{%d}" % self.LONG_RUN).search

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= self.LONG_RUN and self.long_run(text):
            return np.array(self.pre.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


@lru_cache(maxsize=2)
def pretokenizer(path: str) -> Pretokenizer:
    return Pretokenizer(path)
