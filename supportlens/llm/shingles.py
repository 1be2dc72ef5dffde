"""Word shingles of many texts at once, as 64-bit hashes in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Words per shingle.
WIDTH = 5
#: Texts are taken together up to this many bytes, so memory follows the longest text.
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finishing step of a common generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2**bits powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(1 << bits, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word and its hash."""
    codes = np.frombuffer(data, dtype=np.uint8)
    blank = np.concatenate(([True], _BLANK[codes], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(max(20, len(codes).bit_length()))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * power[: len(codes)], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return starts, mixed(value + (ends - starts).astype(np.uint64) * _STEP)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _chunk_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts one after the other, and where each begins."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = _word_hashes(b"\n".join(texts).lower())
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    left = counts[owner] - place
    value = np.zeros(len(hashes), dtype=np.uint64)
    # The windows of a text shorter than one window end with the text.
    for k in range(WIDTH):
        inside = left > k
        following = np.roll(hashes, -k)
        value = np.where(inside, (value + following) * _STEP + np.uint64(k + 1), value)
    wanted = (left >= WIDTH) | (place == 0)
    value, owner = mixed(value[wanted]), owner[wanted]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of UTF-8 texts: hashes and borders, text i of the run being hashes[b[i]:b[i+1]].

    A-Z count as a-z. A text of fewer than five words has its whole sequence as its one
    shingle; a text without words has none.
    """
    for start, end in _chunks(texts):
        yield _chunk_sets(texts[start:end])
