"""Quality by naive Bayes support vectors.

A text is the set of its n-grams: words and pairs of words, runs of three bytes, and runs of up to three word shapes
(letters' case, digits, marks, whether a word repeats the one before), the latter also by how much of the text they
make up. An n-gram's weight in naive Bayes is the logarithm of the ratio of its shares in the two classes; the
indicators are scaled by these ratios, and a linear model with hinge loss is fitted on them by coordinate descent in
the dual: each training row has one multiplier between 0 and C, and passes over the rows in a fixed shuffled order
set each to its best value while the others stay. The model's weights are drawn towards their mean size (INTERPOLATION),
and margins become probabilities by a logistic curve that is fitted on out-of-fold margins.

A bounded sample of the labelled rows (SAMPLE) is used for fitting; Spark reads their texts whole and sends the
hashed n-grams to the driver. Scoring reads every text whole, in tasks, with a model of fixed size (2**HASH_BITS
weights). Only texts make a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, mixed, word_bounds, word_hashes
from .shared import saved, ship, table, text_slices

#: Labelled rows that are used for fitting at most, those with the least hash of the key first.
SAMPLE = 6_000
HASH_BITS = 18
#: Rows of the sample that an n-gram needs, and the count that is added to either class.
MIN_DF, ALPHA = 3, 1.0
C, PASSES, INTERPOLATION, FOLDS = 1.0, 12, 0.25, 4
#: A held-out row: crc32 of the key's text modulo HELD is 0. A text is of label 1 if its score reaches THRESHOLD.
HELD, THRESHOLD = 5, 0.3
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Kinds of bytes: 0 other marks, 1 small letters and bytes beyond ASCII, 2 capitals, 4 digits.
_KIND = np.zeros(256, np.uint8)
_KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x41:0x5B], _KIND[0x30:0x3A] = 2, 4
SHAPES = 64


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(x ^ _U(salt << 56)) >> _U(64 - HASH_BITS)).astype(np.int64)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The shape of each word, below SHAPES: whether it has small letters, two capitals, two marks, a mark at its end, a
    capital at its start, and whether it equals the word before."""
    sums = [np.concatenate([[0], np.cumsum(_KIND[data] == k)]) for k in (0, 1, 2)]
    marks, small, large = (s[ends] - s[starts] for s in sums)
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    out = (small > 0).astype(np.int64) | (large > 1) << 1 | (marks > 1) << 2 | (_KIND[data[ends - 1]] == 0) << 3 | (_KIND[data[starts]] == 2) << 4 | same << 5
    return out if len(starts) else np.zeros(0, np.int64)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed n-grams (sorted, below 2**HASH_BITS) of each row of the bytes."""
    lower = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, ~_SPACE)
    words = word_hashes(lower, starts, ends)
    shapes = _shapes(data, starts, ends, words)
    streams = [_salted(words, 1), _salted(words[:-1] * _U(3) + words[1:], 2)]
    runs = [shapes, shapes[:-1] * SHAPES + shapes[1:], (shapes[:-2] * SHAPES + shapes[1:-1]) * SHAPES + shapes[2:]]
    hashed_runs = [_salted(r.astype(_U), 3 + k) for k, r in enumerate(runs)]
    wide = data.astype(_U)
    trigrams = _salted(wide[:-2] << _U(16) | wide[1:-1] << _U(8) | wide[2:], 6) if len(data) > 2 else np.zeros(0, np.int64)
    seen = np.zeros(1 << HASH_BITS, bool)
    out = []
    for r in range(len(offsets) - 1):
        lo, hi, first, last = int(rows[r]), int(rows[r + 1]), int(offsets[r]), int(offsets[r + 1])
        parts = [streams[0][lo:hi], streams[1][lo : hi - 1], trigrams[first : last - 2]] if hi > lo else []
        parts += [h[lo : hi - k] for k, h in enumerate(hashed_runs) if hi - k > lo]
        if hi > lo:  # how much of the text a shape makes up: one more n-gram for each halving that it stays above
            kinds, n = np.unique(shapes[lo:hi], return_counts=True)
            level = np.floor(-np.log2(n / (hi - lo))).astype(np.int64)
            parts += [_salted((kinds * 64 + k)[level <= k].astype(_U), 7) for k in range(6)]
        for p in parts:
            seen[p] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    return out


class Model:
    """weights (2**HASH_BITS, most are 0), bias, and the logistic curve's slope and offset."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows]) + self.bias

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return _logistic(self.slope * self.margins(rows) + self.offset)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The logarithm of each n-gram's share of all n-grams in label 1 over that in label 0; 0 for rare n-grams."""
    counts = [np.full(1 << HASH_BITS, ALPHA), np.full(1 << HASH_BITS, ALPHA)]
    df = np.zeros(1 << HASH_BITS)
    for r, label in zip(rows, y, strict=True):
        counts[label][r] += 1
        df[r] += 1
    kept = df >= MIN_DF
    shares = [np.where(kept, c, 0) / max(c[kept].sum(), 1e-9) for c in counts]
    out = np.zeros(1 << HASH_BITS)
    out[kept] = np.log(shares[1][kept] / shares[0][kept])
    return out


def dual_descent(rows: list[np.ndarray], values: np.ndarray, sign: np.ndarray, c: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, multipliers) that minimise |w|^2 / 2 + sum of c * max(0, 1 - sign * (w x + bias)), the bias
    being the weight of a constant 1.

    rows: each row's features; values: what a feature is worth wherever it stands. The order of the rows is shuffled
    anew, from a fixed seed, for every pass.
    """
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    held = [values[r] for r in rows]
    size = np.array([float(v @ v) + 1.0 for v in held])
    order = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (float(w[rows[i]] @ held[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / size[i], 0.0), c[i])
            if (step := new - alpha[i]) != 0:
                w[rows[i]] += step * sign[i] * held[i]
                bias += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-6:
            break
    return w, bias, alpha


def _trained(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Both classes weigh the same in the loss, whatever their sizes; values are scaled to rows of length 1 on average."""
    scale = ratios(rows, y)
    kept = [r[scale[r] != 0] for r in rows]
    scale /= max(np.sqrt(np.mean([float(scale[r] @ scale[r]) for r in kept])), 1e-9)
    weight = len(y) / (2.0 * np.bincount(y, minlength=2))
    w, bias, _ = dual_descent(kept, scale, 2.0 * y - 1, C * weight[y])
    used = scale != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return Model(((1 - INTERPOLATION) * mean * used + INTERPOLATION * w) * scale, INTERPOLATION * bias)


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve that fits labels to margins, by Newton's method."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    w = np.array([0.0, np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6))])
    for _ in range(50):
        p = _logistic(x @ w)
        d = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * d[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return max(float(w[0]), 0.0), float(w[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model:
    """The model of n-gram sets and labels 0 and 1. Without both classes every score is the share of label 1 (0.5
    without rows)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(np.zeros(1 << HASH_BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    for f in np.unique(fold):
        mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if len(others) and y[others].min() < y[others].max():
            margins[mine] = _trained([rows[i] for i in others], y[others]).margins([rows[i] for i in mine])
    model = _trained(rows, y)
    model.slope, model.offset = _curve(margins, y)
    return model


def held_out(key) -> F.Column:
    """Whether a row is kept from training: crc32 of the key as text (null: empty) is a multiple of HELD."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most `sample` labelled documents that are not held out, those with the least hash of the key.

    A key with several labels has the largest; null keys and labels are left out; of documents that share a key the
    one with the least text hash is read."""
    ship(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) >= 1).cast("int")).alias("y"))
    known = saved(known.join(docs.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi").orderBy(F.xxhash64("_key"), "_key").limit(sample), "labelled")
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(known), "_key")  # `sample` keys at most
    one = texts.groupBy("_key", "y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))

    def run(batches):
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(2)):
                lists = grams(data, offsets)
                made = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, stop - first) for c in b.columns[:2]], made], names=["row", "y", "grams"])

    made = saved(one.select(F.xxhash64("_key").alias("row"), "y", "_text").mapInArrow(run, "row long, y int, grams array<int>"), "grams")
    got = made.orderBy("row", "y").toArrow()  # `sample` rows at most
    lists = got.column("grams").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    ends = np.cumsum([0, *np.asarray(lists.value_lengths())]) if got.num_rows else np.zeros(1, np.int64)
    flat = np.asarray(lists.flatten()) if got.num_rows else np.zeros(0, np.int32)
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit_rows(rows, np.asarray(got.column("y"), dtype=np.int64), np.arange(got.num_rows) % FOLDS)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and score, of every row; a null text is empty, and empty texts score like the model's bias."""
    ship(docs.sparkSession)
    keep = [c for c in keep if c != "score"]
    used = np.flatnonzero(model.weights)
    small = (used.astype(np.int32), model.weights[used], model.bias, model.slope, model.offset)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    where = len(keep)

    def run(batches):
        weights = np.zeros(1 << HASH_BITS)
        weights[small[0]] = small[1]
        told = Model(weights, *small[2:])
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(where)):
                p = np.round(told.score(grams(data, offsets)), 6)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, stop - first) for c in b.columns[:where]], pa.array(p)], names=[*keep, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")).mapInArrow(run, f"{schema}score double")


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
