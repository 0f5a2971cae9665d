"""Vectorised hashes of words and word shingles inside tasks."""

from __future__ import annotations

import numpy as np

from tracewright.llm.common import WORD_BYTES

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order.

    A word's hash is a polynomial in its bytes modulo 2^64, taken from running sums over the text, so the
    cost is a few vector operations a byte. Long texts go piece by piece, cut between words.
    """
    return word_hashes_of(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES) if text else b"")


def word_hashes_of(data: bytes) -> np.ndarray:
    """The same for bytes whose words are parted by blanks."""
    if not data:
        return np.empty(0, np.uint64)
    if len(data) <= _PIECE:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        end = data.rfind(b" ", at, at + _PIECE) if len(data) - at > _PIECE else len(data)
        if end < 0:
            end = data.find(b" ", at + _PIECE)
            end = len(data) if end < 0 else end
        out.append(_hashes(data[at:end]))
        at = end + 1
    return np.concatenate(out)


def _hashes(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8)
    gap = np.ones(len(own) + 2, bool)
    gap[1:-1] = own == 32
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = turns[::2], turns[1::2]
    power, inverse = _tables(len(own) + 1)
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * power[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The hash of each run of size words, in order; a shorter text has one shingle of all its words, an empty one none."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + words[k : len(words) - size + 1 + k]
    return mix(total + np.uint64(size))
