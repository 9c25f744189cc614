"""Word and shingle hashes of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes | None], stretch: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, number of words of each text). Words are what white space
    [\\x20\\x09-\\x0D] separates, with A-Z lower-cased. Texts are taken together up to `stretch` bytes."""
    hashes, sizes, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < stretch):
            size += len(texts[upto] or b"") + 1
            upto += 1
        part = [t or b"" for t in texts[at:upto]]
        start, h = word_values(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        ends = np.cumsum([len(t) + 1 for t in part])
        hashes.append(h)
        sizes.append(np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(part)))
        at = upto
    return np.concatenate(hashes), np.concatenate(sizes)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text. A text of fewer words has its whole word
    sequence as one shingle; one without words has none."""
    words, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    h = np.zeros(len(words), np.uint64)
    for k in range(n):
        m = max(0, len(words) - k)
        h[:m] = mix(h[:m] ^ words[k:]) + np.uint64(k + 1)
    sets = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        start = end - size
        if size >= n:
            sets.append(np.unique(h[start : end - n + 1]))
        elif size:
            sets.append(np.array([xxhash.xxh64_intdigest(words[start:end].tobytes(), seed=size)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest stretch so far."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(max(n, 1 << 20), base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def word_values(data: np.ndarray, between: np.ndarray = _SPACE, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of the bytes, words being what the bytes of `between` separate: a
    polynomial of random byte values modulo 2**64, by differences of a running sum, stirred with the length
    at the end. Bytes are taken in pieces that end between words, so working memory follows the piece (or the
    longest word)."""
    starts, hashes, at = [], [], 0
    while at < len(data) or not starts:
        upto = min(at + piece, len(data))
        while upto < len(data) and not between[data[upto]]:
            gap = np.flatnonzero(between[data[upto : upto + piece]])
            upto = upto + int(gap[0]) if len(gap) else min(upto + piece, len(data))
        start, h = _piece_values(data[at:upto], between)
        starts.append(start + at)
        hashes.append(h)
        at = upto
    return (starts[0], hashes[0]) if len(starts) == 1 else (np.concatenate(starts), np.concatenate(hashes))


def _piece_values(data: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    up, down = _power_tables(n)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], between[data], [True]])))
    start, stop = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    return start, mix(h ^ ((stop - start).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)))
