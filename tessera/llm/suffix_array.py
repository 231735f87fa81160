"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Induction goes bucket by bucket: all suffixes that a bucket's ready entries induce are
placed at once, so the work is linear with a constant number of array operations for
each symbol. Leftmost-smaller (LMS) substrings are named and their string is sorted
recursively while its alphabet is small; a large alphabet would need a bucket step for each
name, so there the recursion ends in rank doubling.
"""

from __future__ import annotations

import numpy as np

from .common import U64

#: Largest alphabet for which the recursion goes on.
ALPHABET = 600


def _place(out: np.ndarray, at: np.ndarray, values: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Appends values to the buckets of their symbols, in order; ``at`` is where each bucket goes on."""
    order = np.argsort(symbols.astype(np.uint16) if len(at) <= 1 << 16 else symbols, kind="stable")
    symbols, values = symbols[order], values[order]
    count = np.bincount(symbols, minlength=len(at))
    first = np.cumsum(count) - count
    rank = np.arange(len(symbols)) - first[symbols]
    out[at[symbols] + step * rank] = values
    at += step * count


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order; ``size`` counts each symbol."""
    n, k = len(text), len(size)
    end = np.cumsum(size)
    head, tail = end - size, end - 1
    out = np.full(n, -1, np.int64)
    of = np.searchsorted(text[lms], np.arange(k + 1)) if len(lms) else np.zeros(k + 1, np.int64)
    for c in np.flatnonzero(size).tolist():
        done = end[c] - size[c]
        while done < head[c]:
            ready, done = out[done : head[c]], head[c]
            before = ready[ready > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(out, head, before, text[before], 1)
        if of[c] < of[c + 1]:
            before = lms[of[c] : of[c + 1]] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            if len(before):
                _place(out, head, before, text[before], 1)
    for c in np.flatnonzero(size)[::-1].tolist():
        done = end[c] - 1
        if c == 0:
            out[tail[0]] = n - 1  # the end mark
            tail[0] -= 1
        while done > tail[c]:
            ready, done = out[tail[c] + 1 : done + 1][::-1], tail[c]
            before = ready[ready > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(out, tail, before, text[before], -1)
        ready = out[end[c] - size[c] : head[c]][::-1]
        before = ready[ready > 0] - 1
        before = before[small[before] & (text[before] < c)]
        if len(before):
            _place(out, tail, before, text[before], -1)
    return out


def _names(text: np.ndarray, order: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For LMS substrings in order, the number of different ones before each."""
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    open_ = np.flatnonzero(same)
    for k in range(int(length.max(initial=0))):
        if not len(open_):
            break
        open_ = open_[length[a[open_]] > k]
        equal = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
    return np.r_[0, np.cumsum(~same)]


def rank_doubling(text: np.ndarray) -> np.ndarray:
    """The suffix array of any integer string."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order. Symbols are integers from 0; only the last one is 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    turn = np.sign(np.diff(text.astype(np.int64)))
    change = np.flatnonzero(turn)
    small = np.ones(n, bool)
    small[:-1] = turn[change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(text)
    first = lms[np.argsort(text[lms], kind="stable")]
    order = _induce(text, small, first, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    length[n - 1] = 1
    name = _names(text, order, length)
    if name[-1] < len(order) - 1:
        at = np.empty(n, np.int64)
        at[order] = name
        reduced = at[lms]
        deep = suffix_array(reduced) if name[-1] < ALPHABET and len(reduced) < n else rank_doubling(reduced)
        order = lms[deep]
    return _induce(text, small, order, size)


def permuted_lcp(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common): for each suffix the one before it in order (-1: none) and the length of their common prefix.

    Only irreducible values are compared, eight bytes at a time; where the bytes before two
    neighbours agree, the value is one less than that of the suffix one byte earlier.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    word = np.zeros(n + 16, U64)
    word[:n] = data
    for s in (1, 2, 4):
        word[:-s] |= word[s:] << U64(8 * s)
    i = np.arange(n)
    some = before > 0
    reducible = np.zeros(n, bool)
    reducible[1:] = some[1:] & (data[:-1] == data[np.maximum(before[1:], 1) - 1])
    start = np.flatnonzero(~reducible)
    value = np.zeros(len(start), np.int64)
    live = np.flatnonzero(before[start] >= 0)
    a, b = start[live], before[start[live]]
    while len(live):
        differ = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        equal = (differ == 0) & (np.maximum(a, b) + 8 <= n)
        stop = np.flatnonzero(~equal)
        x = differ[stop]
        low = (x & (~x + U64(1))).astype(np.float64)
        value[live[stop]] += np.where(x == 0, 8, np.log2(np.where(low > 0, low, 1)).astype(np.int64) // 8)
        value[live[stop]] = np.minimum(value[live[stop]], n - np.maximum(start[live[stop]], before[start[live[stop]]]))
        keep = np.flatnonzero(equal)
        value[live[keep]] += 8
        live, a, b = live[keep], a[keep] + 8, b[keep] + 8
    which = np.cumsum(~reducible) - 1
    return before, value[which] - (i - start[which])


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each byte on also start at another one. 0xFF, which UTF-8 never has, ends texts."""
    if not len(data):
        return np.zeros(0, bool)
    text = np.r_[data.astype(np.int64) + 1, 0]
    order = suffix_array(text)[1:]
    before, common = permuted_lcp(data, order)
    hit = np.flatnonzero(common >= length)
    out = np.zeros(len(data), bool)
    out[hit] = True
    out[before[hit]] = True
    breaks = np.r_[0, np.cumsum(data == 0xFF)]
    ends = np.minimum(np.arange(len(data)) + length, len(data))
    return out & (breaks[ends] == breaks[: len(data)])
