"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import POWERS, U64, mix, prefix_hashes

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of bytes that aren't ASCII white space; texts lie between the offsets ``at``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = SPACE[data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after[-1], after[:-1] = True, gap[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner], after[inner - 1] = True, True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and the text it is in."""
    start, end, text = word_spans(data, at)
    sums = prefix_hashes(LOWER[data])
    return mix((sums[end] - sums[start]) * POWERS.get(len(data) + 1)[1][start] + (end - start).astype(U64)), text


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending hashes; with fewer words its whole sequence is the one shingle."""
    h, text = word_hashes(data, at)
    n = len(at) - 1
    first = np.searchsorted(text, np.arange(n + 1))
    key = np.zeros(max(0, len(h) - words + 1), U64)
    for j in range(words):
        key += mix(h[j : j + len(key)] + U64((int(ODD[j % 5]) * (j + 1)) % (1 << 64))) * ODD[(j + 1) % 5]
    key = mix(key)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(key[a : b - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            total = np.array([b - a], U64)
            for i in range(a, b):
                total = mix(total * ODD[0] + h[i : i + 1])
            out.append(total)
        else:
            out.append(np.zeros(0, U64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    a, b = mix(s + ODD[0]), mix(s ^ ODD[1])
    return np.array([a.sum(dtype=U64) + U64(len(s)), b.sum(dtype=U64)], U64).tobytes()
