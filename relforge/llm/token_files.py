"""Token ids in files: canonical length-limited Huffman codes from global counts.

Writing: every text is tokenised once and its ids are kept in a table; their counts over all documents give the
code lengths (package-merge, at most the table's width), and canonical codes follow from the lengths alone. Each
document becomes a whole number of bytes with a bit offset for every LANE ids (checkpoints). Documents move to
ranges of their key, are sorted, and are joined into independent blocks, the rows of a Parquet file, in
ascending order of the key. The code book is a table beside them.

Reading: a block is decoded by itself. All its checkpoints advance together, one id per step, each by a look
into a table that the next bits index.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from itertools import chain, pairwise
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import PieceCache
from .shared import saved, shared_dir, ship, table, text_slices

LANE = 512
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 25
WIDTH = 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict[str, tuple[PieceCache, re.Pattern | None, dict[bytes, int]]] = {}


def _tokenizer(path: str) -> tuple[PieceCache, re.Pattern | None, dict[bytes, int]]:
    """One tokenizer and cache for each Python worker, with what finds its added tokens in a text and their ids.

    A byte-level BPE splits a text into words before it merges; so the pieces of a text, which are such words or
    several of them, are encoded on their own, those that the worker has not seen yet. Words are given to the
    library's model without being split again. To the pieces, strings of added tokens are ordinary text;
    _encoded() finds them.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        library = Tokenizer.from_file(path)
        split = library.pre_tokenizer
        added = {t.content: (i, t) for i, t in library.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or not t.special for _, t in added.values()):
            raise ValueError("only special tokens that neither take in nor look at what stands beside them are found by pieces")
        if library.normalizer is not None or not isinstance(split, ByteLevel) or split.add_prefix_space or not split.use_regex or not isinstance(library.model, BPE):
            raise ValueError("only a plain byte-level BPE is encoded by pieces")
        library.encode_special_tokens = True
        words = Tokenizer(library.model)  # of words that are split already, a line for each
        words.pre_tokenizer = CharDelimiterSplit("\n")
        shown = np.arange(256, dtype="<u4")  # the character that stands for each byte
        for byte in [*range(10), *range(11, 33)]:
            shown[byte] = ord(split.pre_tokenize_str(chr(byte))[0][0])
        for byte in range(128, 192):
            shown[byte] = ord(split.pre_tokenize_str(bytes([0xC3, byte]).decode())[0][0][1])
        for byte in range(0xC3, 0xCA):
            shown[byte] = ord(split.pre_tokenize_str(bytes([byte, 0x80]).decode())[0][0][0])
        blank = chr(shown[32])
        opens = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)  # ids whose token begins with a blank
        opens[[i for t, i in library.get_vocab(with_added_tokens=False).items() if t.startswith(blank)]] = True

        def encode(pieces: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
            """Pieces are encoded as one text, in which each begins with its only token that opens with a blank, or
            comes after one that is only a blank; those of kind 'first' one by one."""
            if kind == "plain":
                (found,) = library.encode_batch_fast([f" {' '.join(pieces)}"], add_special_tokens=False)
            elif kind != "first":
                text = f" {'\n '.join(pieces)}" if kind == "blank" else f" \n{'\n \n'.join(pieces)}"
                (found,) = words.encode_batch_fast([shown[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")], add_special_tokens=False)
            if kind != "first":
                ids = np.array(found.ids, np.int32)
                at = np.flatnonzero(opens[ids])
                if len(at) == len(pieces):
                    lengths = np.diff(np.append(at, len(ids)))
                    return (np.delete(ids, at), lengths - 1) if kind == "bare" else (ids, lengths)
            each = [e.ids for e in library.encode_batch_fast(pieces if kind in ("first", "bare") else [f" {p}" for p in pieces], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))

        ids = {content.encode(): i for content, (i, _) in added.items()}
        find = re.compile(b"(%s)" % b"|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None
        _LOADED[path] = PieceCache(encode), find, ids
    return _LOADED[path]


def _encoded(raw: np.ndarray, offsets: np.ndarray, path: str, special: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts (UTF-8, one after the other), and how many each has, as the library's encode(text,
    add_special_tokens=False) gives them: the string of an added (also a special) token is that token, and what lies
    between is encoded on its own. Without `special`, as the library does with encode_special_tokens, such strings are
    ordinary text.
    """
    cache, find, added = _tokenizer(path)
    if not special or find is None or not find.search(raw):
        return cache.ids(raw, offsets)
    data = raw.tobytes()
    parts = [find.split(data[a:b]) for a, b in pairwise(offsets.tolist())]  # every second part is an added token
    plain = [p for each in parts for p in each[::2]]
    flat, counts = cache.ids(np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)]))
    found = iter(np.split(flat, np.cumsum(counts)[:-1]))
    ids = [np.concatenate([[added[p]] if j % 2 else next(found) for j, p in enumerate(each)]) for each in parts]
    return np.concatenate(ids).astype(np.int32), np.array(list(map(len, ids)), np.int64)


def _ids(texts: list[str], path: str, special: bool) -> list[np.ndarray]:
    """_encoded() of a list of texts: the ids of each."""
    data = [t.encode() for t in texts]
    flat, counts = _encoded(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), path, special)
    return np.split(flat, np.cumsum(counts)[:-1]) if texts else []


def _tokenized(docs: DataFrame, path: str, end_id: int, key: str, text: str, special: bool, schema: str, columns) -> DataFrame:
    """id and what columns(ids of some rows, where each row's end) makes of them, with the end id last."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches):
        for b in batches:
            for first, stop, raw, offsets in text_slices(b.column(1)):
                flat, counts = _encoded(raw, offsets, path, special)
                ends = np.cumsum(counts + 1)
                ids = np.full(int(ends[-1]), end_id, np.int32)
                ids[np.delete(np.arange(len(ids)), ends - 1)] = flat
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), *columns(ids, ends)], names=names)
        _tokenizer(path)[0].clear()

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, {schema}")


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values up to each end."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def tokenize(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """id and ids (little-endian 32-bit integers, the end id last) of every row; a null text has the end id only.

    special: whether strings of the tokenizer's added tokens in a text are these tokens."""
    return _tokenized(docs, path, end_id, key, text, special, "ids binary", lambda ids, ends: [_binary(ids.astype("<u4"), ends)])


def _narrow(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Two bytes for each id below 65,536 and the rest (rare or absent) beside them, for the table in between."""
    high = (ids >> 16).astype("<u2")
    rest = [x.tobytes() if x.any() else b"" for x in np.split(high, ends[:-1])] if high.any() else [b""] * len(ends)
    return [_binary(ids.astype("<u2"), ends), pa.array(rest, pa.binary())]


def _wide(low: bytes, high: bytes) -> np.ndarray:
    ids = np.frombuffer(low, "<u2").astype(np.int64)
    return ids + (np.frombuffer(high, "<u2").astype(np.int64) << 16) if high else ids


def global_counts(narrow: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many entries as the vocabulary has at most."""

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for found in [np.bincount(_wide(b"".join(low for low, high in rows if not high), b""), minlength=1), *[np.bincount(_wide(low, high)) for low, high in rows if high]]:
                if len(found) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(found) - len(counts), np.int64)])
                counts[: len(found)] += found
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids])], names=["id", "n"])

    return {r[0]: r[1] for r in narrow.select("low", "high").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n")).collect()}


def code_lengths(counts: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """Lengths of an optimal prefix code with at most `limit` bits (package-merge); 0 for ids that don't occur."""
    lengths, used = np.zeros(len(counts), np.uint8), np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, ceil(log2(len(used))))
    used = used[np.argsort(counts[used], kind="stable")]
    own, level, levels = counts[used], counts[used], [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        pairs = level[0 : len(level) // 2 * 2 : 2] + level[1::2]
        both = np.concatenate([own, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        levels.append(order < len(own))
    take = 2 * len(used) - 2
    for is_own in reversed(levels):
        n_own = int(is_own[:take].sum())
        lengths[used[:n_own]] += 1
        take = 2 * (take - n_own)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code of each id, decoding table of ids, of lengths, table width in bits)."""
    width = max(int(lengths.max(initial=0)), 1)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.int64(1) << (width - lengths[order].astype(np.int64))
    firsts = np.cumsum(spans) - spans
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (firsts >> (width - lengths[order].astype(np.int64))).astype(np.uint64)
    pad = (1 << width) - int(spans.sum())
    fill = lambda values: np.concatenate([np.repeat(values, spans), np.zeros(pad, values.dtype)])
    return codes, fill(order.astype(np.int32)), fill(lengths[order].astype(np.int64)), width


def pack(documents: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """(the bits of each document in whole bytes, its bit offsets at every LANE ids)."""
    counts = np.array([len(d) for d in documents])
    ids = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    bits = lengths[ids].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(bits)])
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sizes = -(-(before[firsts[1:]] - before[firsts[:-1]]) // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = before[:-1] + np.repeat(starts[:-1] * 8 - before[firsts[:-1]], counts)
    words = np.zeros(int(starts[-1]) // 4 + 3, np.uint64)
    value = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    word = at >> 5
    if len(word):
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[cut]] += np.add.reduceat(value >> np.uint64(32), cut)
        words[word[cut] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), cut)
    raw = words.astype(">u4").tobytes()
    lanes = [at[a:b:LANE] - s * 8 for a, b, s in zip(firsts[:-1].tolist(), firsts[1:].tolist(), starts[:-1].tolist(), strict=True)]
    return [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], lanes


def unpack(payload: bytes, offsets: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The ids of lanes that begin at bit offsets and hold counts ids each, lane after lane."""
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    order = np.argsort(-counts, kind="stable")
    at, out_at = offsets[order].copy(), (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.int32)
    live = np.searchsorted(-counts[order], -np.arange(int(counts.max(initial=0))), side="left")
    mask = np.uint32((1 << width) - 1)
    for step, n in enumerate(live.tolist()):
        look = window[at[:n] >> 3] >> (32 - width - (at[:n] & 7)).astype(np.uint32) & mask
        out[out_at[:n] + step] = ids[look]
        at[:n] += lengths[look]
    return out


def _cuts(keyed: DataFrame, n_parts: int) -> list[tuple]:
    """(id, h) of the least row of each range but the first, in order, nulls first: ranges of Spark's own choice, by id
    and then by h, so that the rows of one id, or without one, spread over ranges unless they are copies. A row for each file reaches the
    driver."""
    ranged = keyed.select("id", "h").repartitionByRange(n_parts, F.asc_nulls_first("id"), "h")
    least = ranged.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("id", "h")).alias("cut")).orderBy("at").select("cut.*").collect()
    return [(r["id"], r["h"]) for r in least[1:]]


def _parts(ids: pa.Array, hashes: pa.Array, cuts: list[tuple]) -> list[int]:
    """The range of every row: how many cuts are not above its (id, h)."""
    nulls = sum(c is None for c, _ in cuts)
    bounds, marks = [c for c, _ in cuts[nulls:]], [h for _, h in cuts]
    out = []
    for x, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
        lo, hi = (0, nulls) if x is None else (nulls + bisect_left(bounds, x), nulls + bisect_right(bounds, x))
        out.append(bisect_right(marks, h, lo, hi) if lo < hi else lo)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", special: bool = False) -> None:
    """Writes the ids of all rows under path: ``codes`` (id, length) and ``blocks``; special as in tokenize().

    Rows are in ascending order of the key (a number or a text), nulls first, over the files in order of ``part`` and in
    each by ``block``; rows with equal keys are neighbours, over several files if there are many. An empty table gives
    no blocks.
    """
    spark = docs.sparkSession
    narrow = saved(_tokenized(docs, tokenizer, end_id, key, text, special, "low binary, high binary", _narrow), "ids")
    counts = global_counts(narrow)
    total, top = sum(counts.values()), max(counts, default=0) + 1
    by_id = np.zeros(top, np.int64)
    by_id[list(counts)] = list(counts.values())
    lengths = code_lengths(by_id)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    codes = canonical(lengths)[0]
    kind = narrow.schema[0].dataType.simpleString()
    keyed = narrow.withColumn("h", F.xxhash64("low", "high"))  # parts rows of equal keys

    def run(batches):
        for whole in batches:
            sizes = np.cumsum(pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 2_000_000, side="right")))
                b = whole.slice(at, stop - at)
                documents = [_wide(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                bits, lanes = pack(documents, lengths, codes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, documents), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in lanes], pa.binary()), pa.array(bits, pa.binary()), pa.array(_parts(b.column(0), b.column(3), cuts), pa.int32())], names=["id", "n", "lanes", "bits", "part"])
                at = stop

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_IDS))
    cuts = _cuts(keyed, n_parts)
    packed = keyed.mapInArrow(run, f"id {kind}, n long, lanes binary, bits binary, part int")
    ranged = packed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(F.asc_nulls_first("id"))

    def blocks(batches):
        held, size, start, number = [], 0, 0, 0

        def joined():
            sizes = np.array([len(r[3]) for r in held])
            base = np.repeat((np.cumsum(sizes) - sizes) * 8, [len(r[2]) // 8 for r in held])
            offsets = np.frombuffer(b"".join(r[2] for r in held), "<i8") + base
            values = [[held[0][4]], [number], [start], [[r[0] for r in held]], [[r[1] for r in held]], [offsets.astype("<i8").tobytes()], [b"".join(r[3] for r in held)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "block", "start", "ids", "counts", "checkpoints", "payload"])

        for b in batches:
            id_type = b.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + row[1] > BLOCK_IDS:
                    yield joined()
                    held, size, start, number = [], 0, start + size, number + 1
                held.append(row)
                size += row[1]
        if held:
            yield joined()

    ranged.mapInArrow(blocks, f"part int, block long, start long, ids array<{kind}>, counts array<long>, checkpoints binary, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files at path: id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian 32-bit integers); with keep_ids also token_ids."""
    ship(spark)
    book = spark.read.parquet(f"{path}/codes").collect()  # the vocabulary at most
    lengths = np.zeros(max((r[0] for r in book), default=0) + 1, np.uint8)
    for i, n in book:
        lengths[i] = n
    _, table_ids, table_lengths, width = canonical(lengths)
    found = spark.read.parquet(f"{path}/blocks")
    kind = found.schema["ids"].dataType.elementType.simpleString()
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    parts = found.groupBy("part").agg(F.sum(size).alias("size"))  # a row for each file
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    rows = found.join(F.broadcast(before), "part").select("ids", "counts", "checkpoints", "payload", (F.col("before") + F.col("start")).alias("start"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, counts = b.column(0)[r].values, np.asarray(b.column(1)[r].values, np.int64)
                offsets, payload, start = np.frombuffer(b.column(2)[r].as_py(), "<i8"), b.column(3)[r].as_py(), b.column(4)[r].as_py()
                n_lanes = -(-counts // LANE)
                last = np.cumsum(n_lanes) - 1
                lanes = np.full(int(n_lanes.sum()), LANE)
                lanes[last] = counts - (n_lanes - 1) * LANE
                values = unpack(payload, offsets, lanes, table_ids, table_lengths, width)
                ends = np.cumsum(counts)
                documents = [values[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                made = [ids, pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64())]
                made += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(made, names=["id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * keep_ids)

    return rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * keep_ids)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written as Huffman-coded files and read back."""
    path = f"{shared_dir(spark)}/relforge-tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path(), special=True)
    return read(spark, path).withColumnRenamed("id", "doc_id")
