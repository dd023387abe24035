"""Vectorised 64-bit hashes of the words and word n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed in one numpy step; bounds the temporary arrays.
CHUNK_BYTES = 1 << 20
_BLANK = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, step in enumerate((_BASE, _INVERSE)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [start, stop) of rows whose sizes add up to about ``most``; a larger row stands alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes in the joined texts) of each word, and the words of each text.

    Words are runs of bytes other than space and 09-0D.
    """
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(_BLANK), np.uint8)
    inside = (data != 32).view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up)))
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, first))
    return hashes, starts, ends, counts


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * _ROLES[k]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-gram hashes of each text, sorted, and how many each text has.

    A text of fewer than ``n`` words has its whole sequence as its one n-gram; one without
    words has none.
    """
    hashes, _, _, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    size = np.where(counts >= n, counts - n + 1, 0)
    owner = np.repeat(np.arange(len(texts)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    found = grams(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        owner = np.concatenate((owner, short))
        found = np.concatenate((found, [grams(hashes[starts[i] : ends[i]], int(counts[i]))[0] for i in short]))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order].astype(np.uint64)
    new = np.ones(len(found), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return found[new], np.bincount(owner[new], minlength=len(texts))
