"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The scans of induced sorting are done bucket by bucket: all suffixes of a bucket
that are known at that point induce their predecessors at once, and those that
fall into the same bucket form the next wave. Leftmost-smaller substrings are
sorted recursively by naming ever longer runs of them: a scan of the reduced
text, which has nearly as many buckets as suffixes, would be slow here.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 3
_U = np.uint64


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial hash and the powers that make windows comparable (modulo 2**64)."""
    n = len(values)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) * _U(0xA0761D6478BD642F) + _U(0x5851F42D4C957F2D)) * up[:n], out=sums[1:])
    return sums, down


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last (the sentinel) is."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the text changes
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(following, n - 2)] > 0
    return small


def _place(sa: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, chars: np.ndarray, sign: int) -> None:
    """Put suffixes, in order, at the fill ends of their buckets, which move by ``sign`` a suffix."""
    if not len(suffixes):
        return
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    count = np.diff(np.append(first, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(first, count)
    sa[ends[chars] + sign * rank] = suffixes[order]
    ends[chars[first]] += sign * count


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes ``lms`` induce; ``starts`` are bucket starts."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    used = np.flatnonzero(np.diff(starts))
    heads, tails = starts[:-1].copy(), starts[1:] - 1
    seeds = text[lms]
    seed_order = np.argsort(seeds, kind="stable")
    seeded, seed_starts = lms[seed_order], np.searchsorted(seeds[seed_order], np.arange(len(starts)))
    for c in used:  # larger suffixes, upwards
        low = starts[c]
        while low < heads[c]:
            wave = sa[low : heads[c]]
            low = heads[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            _place(sa, heads, before, text[before], 1)
        before = seeded[seed_starts[c] : seed_starts[c + 1]]
        before = before[before > 0] - 1
        _place(sa, heads, before, text[before], 1)
    for c in used[::-1]:  # smaller suffixes, downwards
        high = starts[c + 1] - 1
        while high > tails[c]:
            wave = sa[tails[c] + 1 : high + 1][::-1]
            high = tails[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            _place(sa, tails, before, text[before], -1)
        wave = sa[starts[c] : heads[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        _place(sa, tails, before, text[before], -1)
    sa[0] = n - 1  # the sentinel is the only one of its bucket
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of names: runs of 1, 2, 4, ... names are named until all names differ."""
    n, width = len(names), 1
    while True:
        pair = names << 32
        pair[: n - width] |= names[width:] + 1
        order = np.argsort(pair)
        head = pair[order]
        names = np.empty(n, np.int64)
        names[order] = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]]))
        width *= 2
        if names[order[-1]] == n - 1:
            return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in sorted order; its last value must be its only 0."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    text = text.astype(np.int64)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(text)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if len(lms) > 1:
        # names of leftmost-smaller substrings, in their order
        found = _induce(text, small, lms, starts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = found[is_lms[found]]
        end = np.append(lms[1:] + 1, n)
        sums, down = prefix_sums(text)
        key = np.zeros((2, n), np.uint64)
        key[0, lms], key[1, lms] = (sums[end] - sums[lms]) * down[lms], end - lms
        new = np.concatenate([[True], (key[:, found[1:]] != key[:, found[:-1]]).any(0)])
        names = np.zeros(n, np.int64)
        names[found] = np.cumsum(new) - 1
        reduced = names[lms]
        if new.all():
            order = np.empty(len(lms), np.int64)
            order[reduced] = np.arange(len(lms))
        else:
            order = _sorted_names(reduced)
        lms = lms[order]
    return _induce(text, small, lms, starts)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, places: np.ndarray | None = None) -> np.ndarray:
    """For each of ``places`` the length it shares with the suffix before its own in the array, up to ``limit``.

    Lengths come from hashes of prefixes by halving steps instead of from one
    place to the next, which numpy can do for all places at once.
    """
    n = len(text)
    here = np.arange(n) if places is None else places
    before = np.full(n, n - 1, np.int64)
    before[sa[1:]] = sa[:-1]
    before = before[here]
    sums, down = prefix_sums(text)
    shared = np.zeros(len(here), np.int64)
    step = 1 << max(0, limit.bit_length() - 1)
    while step:
        a, b = here + shared, before + shared
        fits = (a + step <= n) & (b + step <= n) & (shared + step <= limit)
        a, b = np.where(fits, a, 0), np.where(fits, b, 0)
        same = fits & ((sums[np.minimum(a + step, n)] - sums[a]) * down[a] == (sums[np.minimum(b + step, n)] - sums[b]) * down[b])
        shared += step * same
        step >>= 1
    return shared
