"""Texts as sequences of units (a blank and what follows it), each encoded once for each worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np

_CUT = re.compile(r"(?<=\S)(?= )")
#: White space of every kind, and a blank behind it: where a text is not simply cut at its blanks.
_ODD = [(chr(c), chr(c) + " ") for c in range(0x3001) if chr(c).isspace()]
#: Units, and characters of them, that a worker keeps before it starts afresh; looked at after every slice of texts.
MAX_UNITS, MAX_CHARS = 400_000, 8_000_000
PER_CALL = 20_000


class _Index(dict):
    """unit -> its number; a unit that is looked up for the first time gets the next one and is listed in ``new``."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, unit) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class UnitCache:
    """Ids of texts, by their units.

    A text is cut before every blank that follows something other than white space. `encode` gets distinct
    units, and how they stand in a text: 'first' (at its start), 'plain' (after a blank, without another blank and
    without white space at the end) or 'other' (after a blank). It returns their ids, one unit after the other,
    and how many each has.
    """

    def __init__(self, encode: Callable[[list[str], str], tuple[np.ndarray, np.ndarray]], max_units: int = MAX_UNITS):
        self.encode, self.max_units = encode, max_units
        self.clear()

    def clear(self) -> None:
        """Lets go of all that is kept; a task's last act, so that idle workers hold nothing."""
        self.index, self.chars = _Index(), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, units: list[str], numbers: list[int], kind: str) -> None:
        for at in range(0, len(units), PER_CALL):
            flat, lengths = self.encode(units[at : at + PER_CALL], kind)
            end = self.used + len(flat)
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : end] = flat
            mine = np.array(numbers[at : at + PER_CALL], np.int64)
            self.lengths[mine], self.starts[mine] = lengths, self.used + np.cumsum(lengths) - lengths
            self.used = end

    def _encode_new(self, odd: list[str]) -> None:
        """Encodes what was looked up for the first time; odd: those of them that come from oddly spaced texts."""
        new, self.index.new = self.index.new, []
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.chars += sum(map(len, new))
        other = [u for u in odd if u == "" or " " in u or u[-1].isspace()]
        if other:
            apart = set(other)
            new = [u for u in new if u not in apart]
        for units, kind in ((new, "plain"), (other, "other")):
            self._add(units, list(map(self.index.__getitem__, units)), kind)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; an empty text has none."""
        if len(self.index) > self.max_units or self.chars > MAX_CHARS:
            self.clear()
        number, firsts, odd, at, counts = self.index.__getitem__, [], [], [], []
        for t in texts:
            if not t:
                counts.append(0)
                continue
            simple, units = _units(t)
            known = len(self.index.new)
            firsts.append(units[0])
            units[0] = ""
            counts.append(len(units))
            at.append(-1)
            at += map(number, islice(units, 1, None))
            if not simple:
                odd += self.index.new[known:]
        if self.index.new:
            self._encode_new(odd)
        at = np.array(at, np.int64)
        at[at < 0] = len(self.index) + np.arange(len(firsts))
        mine, sizes = self.encode(firsts, "first") if firsts else (np.zeros(0, np.int32), np.zeros(0, np.int64))  # one for each text, not kept
        all_lengths = np.concatenate([self.lengths[: len(self.index)], sizes])
        all_starts = np.concatenate([self.starts[: len(self.index)], self.used + np.cumsum(sizes) - sizes])
        store = np.concatenate([self.flat[: self.used], mine])
        lengths = all_lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = store[np.arange(total) + np.repeat(all_starts[at] - (ends - lengths), lengths)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _units(text: str) -> tuple[bool, list[str]]:
    """Whether the text is simply cut at its blanks; its first unit, then the others without their leading blank."""
    if text[0] != " " and not text[-1].isspace() and not any([c in text and odd in text for c, odd in _ODD]):
        return True, text.split(" ")
    first, *others = _CUT.split(text)
    return False, [first, *[u[1:] for u in others]]
