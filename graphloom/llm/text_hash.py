"""Words and shingle sets of whole texts as 64-bit hashes, a block of texts at a time in numpy.

Two shingles count as equal if their 64-bit hashes are; for two different ones that happens once in 1e19.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse; the last ones made are kept."""
    if not _known_powers or len(_known_powers[0][0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _known_powers[:] = [(out[0], out[1])]
    return _known_powers[0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) for runs of texts; nulls count as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_BYTES, side="right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word of a block, and the number of words of each text."""
    n = len(data)
    n_texts = len(ends) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts, np.int64)
    size = max(BLOCK_BYTES, 1 << (n - 1).bit_length())
    up, down = _powers(size)
    parts = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n]
    parts[gap] = 0
    hashes = mix(np.add.reduceat(parts, starts) * down[starts])
    counts = np.bincount(np.searchsorted(ends, starts, side="right") - 1, minlength=n_texts)
    return hashes, counts


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: width words each, or all words where there are fewer."""
    for _, data, ends in blocks(texts):
        hashes, counts = word_hashes(data, ends)
        first = np.concatenate([[0], np.cumsum(counts)])
        rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
        for k in range(width if len(rolled) else 0):
            rolled = rolled * _STEP + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        for at, n in zip(first[:-1].tolist(), counts.tolist(), strict=True):
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for h in hashes[at : at + n]:
                        whole = whole * _STEP + h
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return blake2b(hashes.tobytes(), digest_size=16).digest()
