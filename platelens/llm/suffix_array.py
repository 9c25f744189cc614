"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller or larger than their right neighbour. The leftmost smaller ones are
sorted by the substrings between them (one induction sorts those), named, and the string of names, where
names repeat, is sorted in turn; two more scans induce all other suffixes from them. A scan goes bucket by
bucket; what one bucket induces is moved in one step per run of its own letter.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the end counts as smallest."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # equal letters take the type to their right
    return step[at] > 0


def _deal(sa: np.ndarray, j: np.ndarray, letters: np.ndarray, pointer: np.ndarray, down: bool) -> None:
    """Put suffixes j into their letters' buckets, in order, from the pointers on (downwards if `down`)."""
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    count = np.bincount(letters, minlength=256)
    rank = np.arange(len(j)) - (np.cumsum(count) - count)[letters]
    if down:
        sa[pointer[letters] - 1 - rank] = j[order]
        pointer -= count
    else:
        sa[pointer[letters] + rank] = j[order]
        pointer += count


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost smaller suffixes, in the given order, induce."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=256)
    ends = np.cumsum(size)
    starts = ends - size
    lms_size = np.bincount(t[lms], minlength=256)
    lms_order = lms[np.argsort(t[lms], kind="stable")]
    lms_start = np.cumsum(lms_size) - lms_size
    letters = np.flatnonzero(size)

    low = starts.copy()
    sa[low[t[n - 1]]] = n - 1  # the end induces the last suffix
    low[t[n - 1]] += 1
    for c in letters.tolist():
        a = starts[c]
        while a < low[c]:
            j = sa[a : low[c]] - 1
            a = int(low[c])
            j = j[j >= 0]
            j = j[~smaller[j]]
            if len(j):
                _deal(sa, j, t[j], low, False)
        j = lms_order[lms_start[c] : lms_start[c] + lms_size[c]] - 1
        if len(j):
            _deal(sa, j, t[j], low, False)

    high = ends.copy()
    for c in letters[::-1].tolist():
        b = int(ends[c])
        while b > high[c]:
            j = sa[high[c] : b][::-1] - 1
            b = int(high[c])
            j = j[j >= 0]
            j = j[smaller[j]]
            if len(j):
                _deal(sa, j, t[j], high, True)
        j = sa[starts[c] : low[c]][::-1] - 1
        j = j[j >= 0]
        j = j[smaller[j]]
        if len(j):
            _deal(sa, j, t[j], high, True)
    return sa


def _rank_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling (trebling, as long as three ranks go into one integer),
    told apart within `depth` names at least."""
    n, rank, k = len(names), names.astype(np.int64), 1
    parts = 3 if n < 1 << 20 else 2
    while True:
        key = rank + 1
        for i in range(1, parts):
            key *= n + 1
            key[: max(0, n - i * k)] += rank[i * k :] + 1
        order = np.argsort(key)  # equal names may come in any order
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, k = new, parts * k
        if k >= n or k >= depth or int(rank[order[-1]]) == n - 1:
            return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of t (uint8) in order. With `depth`, suffixes that agree on more letters than
    that may come in any order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, smaller, lms)
    sa = _induce(t, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # name the substrings, from one leftmost smaller suffix to the next
    length = np.empty(n, np.int64)
    length[lms] = np.append(lms[1:], n - 1) - lms + 1
    a, b = ordered[:-1], ordered[1:]
    differ = (length[a] != length[b]) | (b == lms[-1]) | (a == lms[-1])
    same = np.flatnonzero(~differ)
    k = 0
    while len(same):
        same = same[length[a[same]] > k]
        unlike = t[a[same] + k] != t[b[same] + k]
        differ[same[unlike]] = True
        same = same[~unlike]
        k += 1
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(differ)])
    if int(name[ordered[-1]]) + 1 < len(lms):
        # a name stands for two letters at least
        ordered = lms[_rank_names(name[lms], len(lms) if depth is None else depth // 2 + 1)]
    return _induce(t, smaller, ordered)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, stop: int, places: np.ndarray | None = None) -> np.ndarray:
    """For each place in t (or each of `places`): how many letters its suffix shares with the suffix before it in sa, up
    to the first letter `stop` (letters `stop` end every text in t, so the work is bounded by the longest text). The
    order is permuted: prefixes are looked up by the place in t, each with its predecessor there."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ends = np.append(np.flatnonzero(t == stop), n)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    view = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    places = np.arange(n) if places is None else places
    out = np.zeros(len(places), np.int64)
    own = np.flatnonzero(before[places] >= 0)
    at = places[own]
    last = before[at]
    left, k = np.minimum(ends[np.searchsorted(ends, at)] - at, n - last), 0
    while len(at):
        unlike = view[at + k] ^ view[last + k]
        same = unlike == 0
        low = np.bitwise_count(~unlike[~same] & (unlike[~same] - np.uint64(1))).astype(np.int64) // 8  # equal bytes in front
        out[own[~same]] = np.minimum(k + low, left[~same])
        done = same & (left <= k + 8)
        out[own[done]] = left[done]
        k += 8
        on = same & ~done
        own, at, last, left = own[on], at[on], last[on], left[on]
    return out
