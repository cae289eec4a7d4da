"""Words and rolling word windows of Arrow text columns as 64-bit hashes, worked out by numpy over a batch's bytes.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum, then mixed. Batches are cut into
slices of a few documents so that the working arrays stay within some tens of megabytes; only a single text longer
than a slice takes more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20


def byte_class(is_gap) -> np.ndarray:
    """For each byte, whether it is part of a word; bytes of multi-byte characters always are."""
    return np.array([b >= 128 or not is_gap(b) for b in range(256)])


#: Words of anything but space and the five control characters tab to carriage return.
SPACED = byte_class(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words of ASCII letters and digits and of all other characters.
ALNUM = byte_class(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, 2**bits of each."""
    n = 1 << bits
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash_slice(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the documents data[offsets[d]:offsets[d + 1]], and each word's d."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    part = in_word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, part[:-1]
    after[-1], after[:-1] = False, part[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    before[firsts], after[lasts] = False, False
    start, end = np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1
    power, inverse = _powers(max(20, int(n).bit_length()))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((FOLD[data].astype(np.uint64) + U(1)) * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)), np.searchsorted(offsets, start, side="right") - 1


def word_hashes(texts: pa.Array, in_word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first, last) of the rows of a text column, with the hash and the row of each of their words, in order.

    Words are compared after lower-casing A-Z. A null text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        h, row = _hash_slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], in_word)
        yield first, last, h, row + first
        first = last


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word's place in ``h`` of each window of k words of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    a = np.full(len(at), k, np.uint64)
    for j in range(k):
        a = mix(a * U(BASE) + h[at + j])
    return a, row[at], at


def text_hash(words: list[str], in_word: np.ndarray = ALNUM) -> list[int]:
    """The window hash of a whole phrase, as a signed long for Spark."""
    (_, _, h, row), *_ = word_hashes(pa.array([" ".join(words)]), in_word)
    return windows(h, row, len(words))[0].view(np.int64).tolist()
