"""Texts as bytes, cut where the split of a byte-level BPE always cuts; each piece is encoded once for each worker."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Kinds of bytes. Letters of two bytes are those that are so in every version of Unicode (U+00C0 to U+024F).
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _BLANK, _LINE = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[39, 32, 10]] = _QUOTE, _BLANK, _LINE
#: Whether a text is cut between bytes of two kinds: 1 if it is, 2 if the bytes before decide. White space is cut off
#: from what stands before it, and a quote is not from what follows, because both may be one word ('s).
_RULE = np.zeros((8, 8), np.uint8)
for _before, _after in {
    _LETTER: (_DIGIT, _MARK, _QUOTE, _BLANK, _LINE),
    _DIGIT: (_LETTER, _MARK, _QUOTE, _BLANK, _LINE),
    _MARK: (_LETTER, _DIGIT, _BLANK, _LINE),
    _QUOTE: (_DIGIT, _BLANK, _LINE),
}.items():
    _RULE[_before, list(_after)] = 1
_RULE[_OTHER, [_BLANK, _LINE]] = 2
_RULE = _RULE.ravel()
#: What the library's split leaves whole.
_WORD = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: Pieces, and characters of them, that a worker keeps before it starts afresh; looked at after every slice of texts.
MAX_PIECES, MAX_CHARS = 400_000, 8_000_000
PER_CALL = 20_000


def starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces of texts (UTF-8, one after the other) begin: at least at every text that is not empty."""
    kind = _KIND[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
    first, second = raw[lead], raw[lead + 1]
    lead = lead[np.where(first == 0xC3, (second != 0x97) & (second != 0xB7), (first < 0xC9) | (second < 0x90))]
    kind[lead] = kind[lead + 1] = _LETTER
    rule = _RULE[kind[:-1] << 3 | kind[1:]]
    cut = np.zeros(len(raw), bool)
    np.equal(rule, 1, out=cut[1:])
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    ask = np.flatnonzero(rule == 2) + 1  # no cut if the character before may be white space
    a, b, c = raw[ask - 1], raw[np.maximum(ask - 2, 0)], raw[np.maximum(ask - 3, 0)]
    cut[ask[(a >= 0x80) & (b != 0xC2) & (c != 0xE1) & (c != 0xE2) & ((c != 0xE3) | (b != 0x80))]] = True
    line = np.flatnonzero(kind[:-1] == _LINE)  # one line feed, between two that are no white space, is a piece
    after = kind[line + 1]
    cut[line[cut[line] & (after >= _LETTER) & (after <= _QUOTE)] + 1] = True
    return np.flatnonzero(cut)


class _Index(dict):
    """piece -> its number; one that is looked up for the first time gets the next and is listed in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class PieceCache:
    """Ids of texts, by their pieces.

    `encode` gets distinct pieces and what they are: 'blank' (a word, digits or marks after a blank, which is left
    out), 'bare' (the same without one), 'plain' (anything after its only blank, which is left out, and not ending in
    white space) or 'first' (anything else). It returns their ids, one piece after the other, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str], str], tuple[np.ndarray, np.ndarray]], max_pieces: int = MAX_PIECES):
        self.encode, self.max_pieces = encode, max_pieces
        self.clear()

    def clear(self) -> None:
        """Lets go of all that is kept; a task's last act, so that idle workers hold nothing."""
        self.index, self.chars = _Index(), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, pieces: list[str], numbers: np.ndarray, kind: str) -> None:
        for at in range(0, len(pieces), PER_CALL):
            flat, lengths = self.encode(pieces[at : at + PER_CALL], kind)
            end = self.used + len(flat)
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : end] = flat
            mine = numbers[at : at + PER_CALL]
            self.lengths[mine], self.starts[mine] = lengths, self.used + np.cumsum(lengths) - lengths
            self.used = end

    def _encode_new(self) -> None:
        """Encodes what was looked up for the first time."""
        new, self.index.new = self.index.new, []
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.chars += sum(map(len, new))
        groups: dict[str, tuple[list[str], list[int]]] = {kind: ([], []) for kind in ("blank", "bare", "plain", "first")}
        for number, (piece, word) in enumerate(zip(new, map(_WORD.fullmatch, new), strict=True), len(self.index) - len(new)):
            after_blank = piece[0] == " "
            if word:
                kind = "blank" if after_blank else "bare"
            else:
                kind = "plain" if after_blank and " " not in piece[1:] and not piece[-1].isspace() else "first"
            pieces, numbers = groups[kind]
            pieces.append(piece[1:] if kind in ("blank", "plain") else piece)
            numbers.append(number)
        for kind, (pieces, numbers) in groups.items():
            self._add(pieces, np.array(numbers, np.int64), kind)

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8, one after the other), and how many each has; an empty text has none."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if len(self.index) > self.max_pieces or self.chars > MAX_CHARS:
            self.clear()
        begin = starts(raw, offsets)
        ends = np.append(begin, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        found = pieces.dictionary.to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        if self.index.new:
            self._encode_new()
        at = numbers[pieces.indices.to_numpy()]
        lengths = self.lengths[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.arange(before[-1]) + np.repeat(self.starts[at] - before[:-1], lengths)]
        return flat, np.diff(before[np.searchsorted(begin, offsets)])
