"""Benchmark decontamination as a prefix-filtered containment join.

Every benchmark window is a set of word shingles. Containment of the whole window asks for all of them, so by
the prefix principle (|x| - ceil(t |x|) + 1 tokens, with t = 1) joining its single rarest shingle is enough.
Rarity is counted over all documents. A document's occurrence of that shingle, at a word position, fixes where
the window would begin; windows that would begin before the text or end after it are out (positional and length
bounds), and for the rest the words themselves are compared, window by window.

The benchmark's distinct windows are taken in blocks of a bounded number. A block's shingle hashes go to the
executors; documents are read once for the counts and once for the candidates of each block and are never shuffled.
Words are counted from distinct windows. A window's items are one list beside it and meet the documents that hold
the window at the end, so a window that stands in many items is matched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, run_hashes, word_bounds, word_hashes
from .shared import saved, ship, table, text_slices

WINDOW = 10
SHINGLE = 3
WINDOWS_PER_BLOCK = 100_000
#: Digits, small letters and all bytes of characters beyond ASCII; texts are lower-cased (A-Z) first.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

_WINDOWS = "item_id {0}, window string, w int, shingles array<long>"
_FILTER_BITS = 22


class _Probe:
    """Exact membership in a set of 64-bit hashes, most misses settled by one look into a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, positions in keys) of those that are members."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _FILTER_BITS)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def _words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, word starts, word ends, words before each row, word hashes)."""
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, IS_WORD)
    return data, starts, ends, rows, word_hashes(data, starts, ends)


def _within(n_words: int, rows: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one row."""
    row = np.searchsorted(rows, np.arange(max(n_words - k + 1, 0)), side="right")
    return np.arange(max(n_words - k + 1, 0)) + k <= rows[np.minimum(row, len(rows) - 1)]


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, window (its words, joined by blanks), w (their number), shingles (hashes in order)."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(1)):
                data, starts, ends, bounds, hashes = _words(data, offsets)
                words = [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
                by_k = {k: run_hashes(hashes, k).view(np.int64) for k in range(1, SHINGLE + 1)}
                out = []
                for r in range(stop - first):
                    lo, hi = bounds[r], bounds[r + 1]
                    w = min(size, hi - lo)
                    k = min(SHINGLE, w)
                    out += [(first + r, " ".join(words[i : i + w]), int(w), by_k[k][i : i + w - k + 1].tolist()) for i in range(lo, hi - w + 1)] if w else []
                ids = b.column(0).take(pa.array([o[0] for o in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["item_id", "window", "w", "shingles"])

    return rows.mapInArrow(run, _WINDOWS.format(rows.schema[0].dataType.simpleString()))


def _count(texts: DataFrame, keys: np.ndarray, sizes: list[int]) -> DataFrame:
    """shingle, n: how often each of the keyed shingles stands in all texts (a single text column)."""

    def run(batches):
        probe = _Probe(keys)
        n = np.zeros(len(probe.keys), np.int64)
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                _, _, _, bounds, hashes = _words(data, offsets)
                for k in sizes:
                    at, key = probe.hits(run_hashes(hashes, k))
                    if len(at):
                        np.add.at(n, key[_within(len(hashes), bounds, k)[at]], 1)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(probe.keys[found].view(np.int64)), pa.array(n[found])], names=["shingle", "n"])

    return texts.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, keys: np.ndarray, sizes: list[int], size: int) -> DataFrame:
    """Each row of docs (keep columns, then a text) with n_words and cands: where a keyed shingle stands, and
    the words around it that a window could cover."""
    keep = docs.columns[:-1]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("position", pa.int32()), ("before", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches):
        probe = _Probe(keys)
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(len(keep))):
                data, starts, ends, bounds, hashes = _words(data, offsets)
                cands = [[] for _ in range(stop - first)]
                for k in sizes:
                    at, key = probe.hits(run_hashes(hashes, k))
                    good = _within(len(hashes), bounds, k)[at]
                    for i, j in zip(at[good].tolist(), probe.keys[key[good]].view(np.int64).tolist(), strict=True):
                        r = int(np.searchsorted(bounds, i, side="right")) - 1
                        lo, hi = max(int(bounds[r]), i - size + k), min(int(bounds[r + 1]), i + size)
                        near = [data[s:e].tobytes().decode() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                        cands[r].append({"shingle": j, "position": i - int(bounds[r]), "before": i - lo, "words": near})
                part = b.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(np.diff(bounds), pa.int64()), pa.array(cands, kind)], names=[*keep, "n_words", "cands"])

    return docs.mapInArrow(run, f"{kept}, n_words long, cands array<struct<shingle:long,position:int,before:int,words:array<string>>>")


def overlap(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per row of docs: its key, n_words, n_hit (words inside an occurrence of any window), items (the
    sorted ids, as strings, of the benchmark items that have one), n_items, hits (start and w of every occurrence)
    and contaminated.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A null or empty text has
    no words; items without words match nothing; an item without an id marks words but is neither listed nor
    counted; null keys stay; repeated rows are counted each on their own. Memory follows the longest text. The key's
    column is the only one that is kept.
    """
    ship(docs.sparkSession)
    every = saved(windows(benchmark, size, item, text), "windows")
    distinct = saved(every.groupBy("window").agg(F.first("w").alias("w"), F.first("shingles").alias("shingles"), F.collect_set(F.col("item_id").cast("string")).alias("of_window")).withColumn("number", F.monotonically_increasing_id()), "distinct")
    n_blocks = -(-distinct.count() // WINDOWS_PER_BLOCK)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = None
    for block in range(max(n_blocks, 1)):
        mine = distinct.where(F.pmod(F.xxhash64("window"), F.lit(max(n_blocks, 1))) == block).drop("of_window")
        exploded = mine.select("number", "window", "w", F.posexplode("shingles").alias("offset", "shingle"))
        keys = _hashes(exploded)
        sizes = [r[0] for r in mine.select(F.least("w", F.lit(SHINGLE))).distinct().orderBy(F.least("w", F.lit(SHINGLE))).collect()]
        counts = saved(_count(rows.select("_text"), keys, sizes), "rarity") if len(keys) else None
        if counts is None:
            prefix = exploded.where("false").withColumn("n", F.lit(0))
        else:
            prefix = exploded.join(F.broadcast(counts), "shingle", "left").groupBy("number", "window", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p"))
            prefix = saved(prefix.select("number", "window", "w", "p.n", "p.shingle", "p.offset").where("n > 0"), "prefix")
        words = F.slice("cand.words", F.col("cand.before") - F.col("offset") + 1, F.col("w"))
        fits = (F.col("cand.before") >= F.col("offset")) & (F.concat_ws(" ", words) == F.col("window"))
        part = (
            _candidates(rows, _hashes(prefix), sizes, size)
            .select("_row", "_key", "n_words", F.explode_outer("cands").alias("cand"))
            .join(F.broadcast(prefix), (F.col("cand.shingle") == F.col("shingle")) & fits, "left")  # a block of distinct windows at most
            .select("_row", "_key", "n_words", "number", F.when(F.col("window").isNotNull(), F.struct((F.col("cand.position") - F.col("offset")).alias("start"), "w")).alias("hit"))
        )
        found = part if found is None else found.unionByName(part)
    # at each position of a text a window of each length at most
    held = saved(found.groupBy("_row", "_key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("hit")).alias("hits"), F.collect_set("number").alias("numbers")), "held")
    end = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n"))
    reach = lambda a, h: F.greatest(a["end"], h["start"] + h["w"])
    union = F.aggregate("hits", end, lambda a, h: F.struct(reach(a, h).alias("end"), (a["n"] + reach(a, h) - F.greatest(a["end"], h["start"])).cast("long").alias("n")), lambda a: a["n"])
    lists = held.where(F.size("numbers") > 0).select("_row", F.explode("numbers").alias("number")).join(distinct.select("number", "of_window"), "number")
    items = lists.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("of_window")))).alias("items"))
    none = F.array().cast("array<string>")
    return held.join(items, "_row", "left").select(F.col("_key").alias(key), "n_words", union.alias("n_hit"), F.coalesce("items", none).alias("items"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), "hits", (F.size("hits") > 0).alias("contaminated"))


def _hashes(df: DataFrame) -> np.ndarray:
    """The distinct shingles of one block: eight for each of its windows at most."""
    return np.fromiter((r[0] for r in df.select("shingle").distinct().toLocalIterator()), np.int64).view(np.uint64)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Words of every document inside a 10-word window of the benchmark."""
    out = overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
g AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS span
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, k, i, item_id FROM g JOIN win USING (k, span)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)
"""
