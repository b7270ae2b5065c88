"""Words and word shingles of many texts at once, as 64-bit numbers in numpy arrays.

A word is a run of bytes other than white space, its letters A-Z in lower case. A shingle is five words in a row, or the
whole sequence where a text has fewer words. Both are hashed with a full 64-bit mix.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
#: Bytes hashed at once.
BLOCK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mix of 64-bit numbers in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        table = np.full(size, _BASE | 1, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one block that begins and ends between words."""
    inside = ~_IS_SPACE[data]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    letters = _LOWER[data[inside]].astype(np.uint64) + np.uint64(1)
    firsts = np.cumsum(sizes) - sizes
    places = np.arange(len(letters)) - np.repeat(firsts, sizes)
    sums = np.add.reduceat(letters * _power_table(int(sizes.max()))[places], firsts)
    return starts, mix64(sums + sizes.astype(np.uint64) * np.uint64(_BASE))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each text's first word (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    begins = np.concatenate(([0], np.cumsum(lengths)))
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _IS_SPACE[data[end - 1]]:
            step = np.flatnonzero(_IS_SPACE[data[end:end + 4096]])
            end = min(end + (int(step[0]) + 1 if len(step) else 4096), len(data))
        s, h = _block_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), np.searchsorted(starts, begins)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order (repeats kept), and the offset of each text's first shingle."""
    counts = np.diff(offsets)
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += padded[j:j + n] * _PLACES[j]
    owner_end = np.repeat(offsets[1:], counts)
    full = owner_end - np.arange(n) >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    keep = full.copy()
    if len(short):
        at = offsets[short]
        value = np.zeros(len(short), dtype=np.uint64)
        for j in range(size):
            value += np.where(counts[short] > j, padded[at + j] * _PLACES[j], np.uint64(0))
        total[at] = value + counts[short].astype(np.uint64)
        keep[at] = True
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    return mix64(total[keep]), np.concatenate(([0], np.cumsum(out_counts)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    grams, offsets = shingles(*words(texts))
    return [np.unique(grams[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
