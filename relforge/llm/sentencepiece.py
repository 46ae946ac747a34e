"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is normalised as the model asks for (a blank in front, blanks as U+2581) and cut before blanks; no piece
holds a blank behind another character, so the units are independent. Distinct units advance together: from all
their positions a trie of the pieces is walked at once, as long as there is a piece that begins like that, and what
is found are the edges; at each end position the best sum of scores is a maximum over the edges of all units, and
its start is the backpointer. Characters without a piece fall back to their bytes.

The result is the segmentation with the largest sum of piece scores, which is what the library's unigram
decoder gives for the same pieces and scores. The model at hand was trained by merging pairs, and the library's
own encoder follows the order of the merges there; the ids of the two differ on some words while both decode
to the same text (see the README for figures).
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, ship, table, text_slices
from .units import UnitCache

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct units that a worker keeps at most between slices of texts.
MAX_UNITS = 150_000
#: Positions of units that are searched together.
CELLS = 1 << 17


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file as a trie with scores and ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = np.full(256, model.unk_id(), np.int32)
        self.byte_of = {}
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
                self.byte_of[i] = bytes([int(self.text[i][3:5], 16)])
        self.hidden = {i for i in range(n) if model.is_control(i)}
        scores = np.array([model.get_score(i) for i in plain])
        for i in plain:
            if SPACE in self.text[i].lstrip(SPACE):
                raise ValueError(f"piece {i} holds a blank behind another character")
        self.longest = max(len(self.text[i]) for i in plain)
        self.scores, self.ids = scores, np.array(plain, np.int32)
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.gain, self.piece_ids = np.append(self.unknown, scores), np.append(np.int32(-1), self.ids)
        self._trie([self.text[i] for i in plain])

    def _trie(self, texts: list[str]) -> None:
        """A trie of the pieces in one array of slots: a node's child by letter c is slot base[node] + c, if above[slot]
        is the node. Nodes are named by their slots; 0 is none."""
        letters = sorted(set("".join(texts)))
        self.letter = np.zeros(0x110000, np.min_scalar_type(len(letters)))  # 0: in no piece
        self.letter[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        nodes = {t: i for i, t in enumerate(dict.fromkeys(t[:n] for t in texts for n in range(1, len(t) + 1)))}
        tops, deep = [t for t in nodes if len(t) == 1], [t for t in nodes if len(t) > 1]
        top, child, parent = (np.array([nodes[t] for t in x], np.int64) for x in (tops, deep, [t[:-1] for t in deep]))
        by = self.letter[np.array([ord(t[-1]) for t in deep], np.int64)].astype(np.int64)
        base, slot_of, taken = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), np.zeros(4 * len(nodes) + len(letters), bool)
        slot_of[top] = np.arange(1, len(top) + 1)
        taken[: len(top) + 1] = True
        children = np.bincount(parent, minlength=len(nodes))
        rank = np.empty(len(nodes), np.int64)
        rank[np.argsort(-children, kind="stable")] = np.arange(len(nodes))
        rng = np.random.default_rng(0)
        for least, most in pairwise((len(letters) + 1, 64, 16, 4, 1)):  # nodes of many children first
            left = np.flatnonzero((children[parent] < least) & (children[parent] >= most))
            while len(left):  # each tries a place; of several that want a slot the one of most children has it
                mine = parent[left]
                place = rng.integers(1, len(taken) - len(letters), len(nodes))
                slot = place[mine] + by[left]
                owner = np.full(len(taken), len(nodes))
                np.minimum.at(owner, slot, rank[mine])
                placed = np.ones(len(nodes), bool)
                placed[mine[taken[slot] | (owner[slot] != rank[mine])]] = False
                good = placed[mine]
                base[mine[good]], slot_of[child[left[good]]], taken[slot[good]] = place[mine[good]], slot[good], True
                left = left[~good]
                taken = np.append(taken, np.zeros(len(nodes) // 16, bool))  # room for those that found none
        self.base, self.above = np.zeros(len(taken), np.int32), np.full(len(taken), -1, np.int32)
        self.piece, self.root = np.zeros(len(taken), np.int32), np.zeros(len(letters) + 1, np.int32)
        self.base[slot_of], self.above[slot_of[child]] = base, slot_of[parent]
        self.piece[slot_of[[nodes[t] for t in texts]]] = np.arange(1, len(texts) + 1)
        self.root[self.letter[list(map(ord, tops))]] = slot_of[top]

    def encode(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit."""
        flat, counts = self.encode_flat(units)
        return np.split(flat, np.cumsum(counts)[:-1]) if units else []

    def encode_flat(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one unit after the other, and how many each has; units are searched together."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends, found, at = np.cumsum(sizes), [], 0
        while at < len(units):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CELLS, side="right")))
            found.append(self._viterbi("".join(units[at:stop]), sizes[at:stop]))
            at = stop
        if not found:
            return np.zeros(0, np.int32), sizes
        return np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])

    def _viterbi(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that stand one after the other in `text`, and how many each has.

        Cells are positions of units: row j holds position j of all units that reach it, longest units first. Rows are
        gone through in blocks, so that the edges at hand are bounded.
        """
        n, length = len(sizes), int(sizes.max())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(n)
        width = n - np.searchsorted(np.sort(sizes), np.arange(length + 1))
        row = np.concatenate([[0], np.cumsum(width)])
        step = np.repeat(width, width).astype(np.int32)  # from a cell to the unit's next one
        first = np.cumsum(sizes) - sizes
        cell = row[np.arange(len(points)) - np.repeat(first, sizes)] + np.repeat(rank, sizes)  # of each character
        letter, inside = np.zeros(len(step), self.letter.dtype), np.zeros(len(step), bool)
        letter[cell], inside[cell] = self.letter[points], True
        best, start, piece = np.zeros(len(step)), np.zeros(len(step), np.int32), np.zeros(len(step), np.int32)
        kept = [(np.zeros(0, np.int32),) * 3] * self.longest  # edges that end behind the block, by length
        at = 0
        while at < length:
            stop = min(max(at + 1, int(np.searchsorted(row, row[at] + CELLS, side="right")) - 1), length)
            edges = self._edges(row[at] + np.flatnonzero(inside[row[at] : row[stop]]), letter, step)
            for k, found in enumerate(edges):
                every = [np.concatenate(x) for x in zip(kept[k], found, strict=True)]
                here = int(np.searchsorted(every[1], row[stop + 1]))
                edges[k], kept[k] = tuple(x[:here] for x in every), tuple(x[here:] for x in every)
            self._advance(edges, row[at + 1 : stop + 2], best, start, piece)
            at = stop
        on, back = np.zeros(len(step), bool), row[sizes] + rank
        while len(back := back[back >= n]):
            on[back] = True
            back = start[back]
        ends = cell + step[cell]
        chosen = on[ends]
        flat, counts = self._with_bytes(piece[ends[chosen]], points[chosen])
        upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(chosen)])]
        return flat, np.diff(upto[np.append(first, len(points))])

    def _advance(self, edges: list[tuple[np.ndarray, ...]], row: np.ndarray, best: np.ndarray, start: np.ndarray, piece: np.ndarray) -> None:
        """Best sums of the cells of some rows (`row` has their bounds), with the start and the piece of the last edge."""
        at = np.zeros(row[-1] - row[0] + 1, np.int64)  # where the edges to each cell begin
        for _, end, _ in edges:
            at[end - row[0] + 1] += 1
        at = np.cumsum(at)
        free, starts, pieces = at[:-1].copy(), np.empty(at[-1], np.int32), np.empty(at[-1], np.int32)
        for s, end, p in reversed(edges):  # the longest first
            to = free[end - row[0]]
            free[end - row[0]] += 1
            starts[to], pieces[to] = s, p
        gain = self.gain[pieces]
        for lo, hi in pairwise(row.tolist()):
            of = at[lo - row[0] : hi - row[0] + 1]
            best[lo:hi] = np.maximum.reduceat(best[starts[of[0] : of[-1]]] + gain[of[0] : of[-1]], of[:-1] - of[0])
        hit = np.flatnonzero(best[starts] + gain == np.repeat(best[row[0] : row[-1]], np.diff(at)))
        hit = hit[np.searchsorted(hit, at[:-1])]  # the first of equal sums: the longest piece
        start[row[0] : row[-1]], piece[row[0] : row[-1]] = starts[hit], pieces[hit]

    def _with_bytes(self, piece: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has: a character without a piece (its last code point) has its bytes'."""
        flat, counts, bare = self.piece_ids[piece], np.ones(len(piece), np.int64), piece == 0
        if bare.any():
            c = points[bare]
            counts[bare] += (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
            flat = np.repeat(flat, counts)
            flat[np.repeat(bare, counts)] = self.bytes[np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8)]
        return flat, counts

    def _edges(self, cells: np.ndarray, letter: np.ndarray, step: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length the pieces at `cells`: first cell, cell behind the last one, piece (0: a character without one)."""
        start, state = cells.astype(np.int32), self.root[letter[cells]]
        end = start + step[start]
        out = [(start, end, self.piece[state])]
        for _ in range(1, self.longest):
            slot = self.base[state] + letter[end]
            on = np.flatnonzero(self.above[slot] == state)
            start, end, state = start[on], end[on], slot[on]
            end = end + step[end]
            piece = self.piece[state]
            some = np.flatnonzero(piece)
            out.append((start[some], end[some], piece[some]))
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], b""
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                raw += byte
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = b""
            if i not in self.hidden:
                out.append(self.text[i])
        return "".join([*out, raw.decode(errors="replace")]).replace(SPACE, " ")[1:]


_LOADED: dict[str, tuple[Pieces, UnitCache]] = {}


def _loaded(path: str) -> tuple[Pieces, UnitCache]:
    """One model and cache for each Python worker."""
    if path not in _LOADED:
        pieces = Pieces(path)

        def units(texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
            return pieces.encode_flat([SPACE + u.replace(" ", SPACE) for u in texts])

        _LOADED[path] = pieces, UnitCache(units, MAX_UNITS)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns with n_chars (code points) and ids; a null or empty text has no ids. keep columns with the name
    of a made one are replaced."""
    ship(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_chars", "ids", "_text")]
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        _, cache = _loaded(path)
        for b in batches:
            for first, stop, _, _ in text_slices(b.column(len(keep))):
                part = b.slice(first, stop - first)
                texts = part.column(len(keep)).fill_null("").to_pylist()
                ids = cache.ids(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(map(len, texts), pa.int64()), lists], names=[*keep, "n_chars", "ids"])
        cache.clear()

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{kept}n_chars long, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids", digest: bool = False) -> DataFrame:
    """keep columns with text; with digest instead n_ids, ids_crc32 (of the ids as little-endian 32-bit
    integers) and text_crc32 (of the decoded text's UTF-8 bytes). Null ids decode to an empty text. keep columns with
    the name of a made one are replaced."""
    ship(encoded.sparkSession)
    extra = ["n_ids", "ids_crc32", "text_crc32"] if digest else ["text"]
    keep = [c for c in keep if c not in (*extra, "_ids")]
    rows = encoded.select(*keep, F.col(ids).alias("_ids"))

    def run(batches):
        pieces, _ = _loaded(path)
        # every piece's bytes, so that a text is one join
        raw = np.array([pieces.byte_of.get(i, b"" if i in pieces.hidden else t.replace(SPACE, " ").encode()) for i, t in enumerate(pieces.text)], object)
        for b in batches:
            column = b.column(len(keep))
            values = column.values.to_numpy(zero_copy_only=False)
            offsets = column.offsets.to_numpy()
            texts, sums = [], []
            for lo, hi, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_null().to_pylist(), strict=True):
                mine = values[lo:hi] if not null else values[:0]
                texts.append(b"".join(raw[mine].tolist())[1:])
                sums.append((len(mine), zlib.crc32(mine.astype("<u4").tobytes())))
            if digest:
                made = [pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())]
            else:
                made = [pa.array([t.decode(errors="replace") for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *extra])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, kept + ("n_ids long, ids_crc32 long, text_crc32 long" if digest else "text string"))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's number of pieces, the checksum of their ids, and whether they decode to the text."""
    path = model_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("source_crc32"))
    ids = saved(encode(docs, path, ["doc_id", "source_crc32"]), "pieces")  # so that no task runs two Python workers
    back = decode(ids, path, ["doc_id", "source_crc32"], digest=True)
    return back.select("doc_id", F.col("n_ids").alias("n_pieces"), "ids_crc32", (F.col("source_crc32") == F.col("text_crc32")).alias("round_trip"))
