"""Vectorised hashes of words and word runs over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIER = _U(0xD6E8FEB86659FD93)
#: Bytes that are hashed together; what is held beside the text is a fixed multiple of it.
BLOCK = 1 << 17


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(BLOCK, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWER, _BACK = _powers(_BASE), _powers(_INVERSE)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the maximal runs of word bytes; runs end at row bounds."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = np.unique(inner[(inside[inner] == 1) & (inside[inner + 1] == 1)]) if len(inner) else inner
    if len(cut):  # a row bound between two word bytes
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, the same wherever the word stands."""
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        first = int(starts[at])
        stop = int(np.searchsorted(ends, first + BLOCK, side="right"))
        if stop > at:
            piece = data[first : int(ends[stop - 1])]
            sums = np.zeros(len(piece) + 1, _U)
            np.cumsum((piece + _U(1)) * _POWER[: len(piece)], out=sums[1:])
            s, e = starts[at:stop] - first, ends[at:stop] - first
            out[at:stop] = (sums[e] - sums[s]) * _BACK[s]
            at = stop
            continue
        total, shift = _U(0), _U(1)  # a word longer than a block
        for lo in range(first, int(ends[at]), BLOCK):
            piece = data[lo : min(lo + BLOCK, int(ends[at]))]
            with np.errstate(over="ignore"):
                total, shift = total + ((piece + _U(1)) * _POWER[: len(piece)]).sum(dtype=_U) * shift, shift * _POWER[-1] * _BASE
        out[at] = total
        at += 1
    return mixed(out + (ends - starts).astype(_U))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words of the whole array; callers keep those inside one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.full(n, k, _U)
    for j in range(k):
        total = (total ^ words[j : j + n]) * _MULTIPLIER + (total >> _U(29))
    return mixed(total)
