"""Numpy helpers over whole Arrow batches: words, shingles and windows as 64-bit hashes, without Python objects for each word.

A text column is taken as its Arrow buffers (one byte array for the whole batch and the offsets of the texts), so every
step below is a vector operation over a batch. Batches are cut by bytes first, so memory depends on the longest text only.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer single text is worked on alone).
CHUNK_BYTES = 1 << 19
U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A 64-bit value for each byte, by rule.
BYTE_VALUES = mixed((np.arange(256, dtype=U64) + U64(1)) * _ODD)
#: A-Z to a-z; all other bytes stay, so multi-byte characters do too.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Bytes of words [^\x20\x09-\x0D]+ .
SPACED_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and every byte of a multi-byte character.
PLAIN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, U64)
    down = np.full(n + 1, _BASE_INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64) up to n at least."""
    return _powers(max(CHUNK_BYTES + 4096, 1 << int(n).bit_length()))


def give_back() -> None:
    """Returns freed memory to the system: a worker process is used again for other stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each part hold about `size` bytes; null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        if column.null_count:
            batch = batch.set_column(at, text, column.fill_null(""))
            column = batch.column(at)
        ends = utf8(column)[1][1:]
        begin = 0
        while begin < len(column):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column without nulls, end to end, and the offsets of the texts in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: hash, start and end byte of each, and the words' offsets of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word_bytes[data if word_bytes is SPACED_WORD else self.data]
        cut = np.zeros(n + 1, bool)  # a text begins here
        cut[offsets[:-1]] = True
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here[:n] & (~before[:n] | cut[:n]))
        ends_here = before & (~here | cut)
        self.ends = np.flatnonzero(ends_here)
        self.text_offsets = np.searchsorted(self.starts, offsets)
        if n:
            up, down = powers(n)
            sums = np.zeros(n + 1, U64)
            np.cumsum(BYTE_VALUES[self.data] * up[:n], out=sums[1:])
            self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))
        else:
            self.hashes = np.zeros(0, U64)

    def counts(self) -> np.ndarray:
        return np.diff(self.text_offsets)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word runs at every word, and which of them stay within their text."""
        w, total = self.hashes, len(self.hashes)
        value = np.zeros(total, U64)
        for k in range(n):
            value[: max(total - k, 0)] += w[k:] * U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        fits = np.zeros(total, bool)
        last = np.repeat(self.text_offsets[1:], self.counts())
        fits[:] = np.arange(total) + n <= last
        return mixed(value + U64(n)), fits

    def whole(self) -> np.ndarray:
        """A hash of each text's whole sequence of words."""
        counts = self.counts()
        place = np.arange(len(self.hashes)) - np.repeat(self.text_offsets[:-1], counts)
        up, _ = powers(int(counts.max()) if len(counts) else 0)
        sums = np.zeros(len(self.hashes) + 1, U64)
        np.cumsum(self.hashes * up[place + 1], out=sums[1:])
        return mixed(sums[self.text_offsets[1:]] - sums[self.text_offsets[:-1]] + counts.astype(U64))


def distinct_in_texts(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (owner, value) pairs, sorted by owner, then value, and a place where each was."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new], order[new]
