"""Toxicity by a classifier chain.

The chain predicts the categories one after the other. Each link is a linear (logistic) model on which words a
text has and on the probabilities of the categories before it; in training those are out-of-fold predictions,
so that a later link sees earlier ones as wrong as they will be on new texts. Words are chosen anew from the training
rows of each fold, so a held-out row's prediction owes nothing to its label. The last category is the label itself.
Before it come the categories that the labels table has, and kinds of the label that are learned from the texts: the
label's telling words fall into two groups by which of them stand together, and a text of the label is of a kind if
it has a word of its group. Kinds too are learned anew for each fold from the other folds' rows. There is no word list.

A bounded sample of the labelled rows (SAMPLE) is used for fitting. Spark counts their words by fold and label; only
the chosen words' counts and which rows have them reach the driver. Scoring reads every text whole, on the
executors, with a model of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, word_bounds, word_hashes
from .shared import saved, ship, table, text_slices

#: Labelled rows that are used for fitting at most, those with the least hash of the key first.
SAMPLE = 8_000
FEATURES = 256
FOLDS = 4
L2 = 0.03
MIN_ROWS = 4
#: Least chi-square (one degree of freedom) of a word against any category; chance alone passes in about one of 10^5.
CHI_SQUARE = 40.0
MIN_DF = 5
#: Bounds of the threshold that is chosen on out-of-fold predictions.
THRESHOLDS = (0.2, 0.5)
#: Small letters and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: Columns of the labels table that come before the label in the chain, where the table has them.
CATEGORIES = ("quality",)
KINDS = 2


def _hashed(data: np.ndarray, offsets: np.ndarray):
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, IS_WORD)
    return word_hashes(data, starts, ends), rows


class Chain:
    """A fitted chain: words (sorted hashes), and for each category a bias, word weights and earlier weights."""

    def __init__(self, names: list[str], words: np.ndarray, weights: np.ndarray, threshold: float = THRESHOLDS[1]):
        self.names, self.words, self.weights, self.threshold = names, words, weights, threshold

    def score(self, present: np.ndarray) -> np.ndarray:
        """rows x categories probabilities for rows x words presence."""
        out = np.zeros((len(present), len(self.names)))
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(w[0] + present @ w[1 : 1 + len(self.words)] + out[:, :c] @ w[1 + len(self.words) :][:c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 8) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the bias (first column) is not shrunk."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], L2)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        d = np.maximum(p * (1 - p), 1e-4)
        w -= np.linalg.solve((x * d[:, None]).T @ x + np.diag(ridge + 1e-8), x.T @ (p - y) + ridge * w)
    return w


def fit_chain(present: np.ndarray, labels: list[np.ndarray], names: list[str], words: np.ndarray, chosen: list[np.ndarray], fold: np.ndarray) -> Chain:
    """present: rows x words; labels: rows x categories of 0 and 1 in the chain's order, as the rows of the other folds
    tell them for each fold, and last as all rows do; chosen: likewise the words (positions); fold: of each row.

    A category without both classes, or fewer than MIN_ROWS rows, gives a chain that predicts each category's share.
    """
    n, k = labels[-1].shape
    x = np.hstack([np.ones((n, 1)), present])
    columns = [np.concatenate([[0], c + 1]) for c in chosen]
    own = chosen[-1]
    weights = np.zeros((k, 1 + len(own) + k))
    held = np.zeros((n, k))  # out-of-fold probabilities
    for c in range(k):
        y = labels[-1][:, c].astype(float)
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1e-6
        if n < MIN_ROWS or y.min() == y.max():
            weights[c, 0], held[:, c] = np.log(share / (1 - share)), share
            continue
        for f in range(len(chosen) - 1):
            mine = fold == f
            if mine.any() and not mine.all():
                full = np.hstack([x[:, columns[f]], held[:, :c]])
                held[mine, c] = _sigmoid(full[mine] @ _logistic(full[~mine], labels[f][~mine, c].astype(float)))
        w = _logistic(np.hstack([x[:, columns[-1]], held[:, :c]]), y)
        weights[c, : 1 + len(own)], weights[c, 1 + len(own) : 1 + len(own) + c] = w[: 1 + len(own)], w[1 + len(own) :]
    return Chain(names, words[own], weights, _threshold(held[:, -1], labels[-1][:, -1]) if n else THRESHOLDS[1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the cut with the best F1, within THRESHOLDS."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(p[:-1] > p[1:], True))  # a cut keeps equal probabilities together
    best = last[np.argmax(2 * hits[last] / (last + 1 + max(hits[-1], 1)))]
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[best] + below) / 2, *THRESHOLDS))


def kinds_of(present: np.ndarray, label: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """rows x KINDS of 0 and 1: kinds of the label, from the telling words (positions).

    The words' first principal component over the label's rows parts them into two groups that tend to stand in
    different texts."""
    out = np.zeros((len(label), KINDS), np.int8)
    rows = present[label > 0][:, telling]
    if len(rows) < 2 or len(telling) < 2:
        return out
    load = np.linalg.eigh(np.cov(rows, rowvar=False))[1][:, -1]
    load *= np.sign(load[np.argmax(np.abs(load))])
    for k, group in enumerate((telling[load > 0], telling[load <= 0])):
        out[:, k] = (label > 0) & present[:, group].any(axis=1)
    return out


def fold_kinds(present: np.ndarray, label: np.ndarray, telling: list[np.ndarray], fold: np.ndarray) -> list[np.ndarray]:
    """The kinds as the rows outside each fold tell them (0 for the fold's own rows), and last as all rows do. Which of
    two kinds is the first is settled by their agreement with those of all rows."""
    whole = kinds_of(present, label, telling[-1])
    out = []
    for f, words in enumerate(telling[:-1]):
        others = fold != f
        mine = np.zeros_like(whole)
        mine[others] = kinds_of(present[others], label[others], words)
        same, turned = (mine[others] == whole[others]).sum(), (mine[others][:, ::-1] == whole[others]).sum()
        out.append(mine if same >= turned else mine[:, ::-1])
    return [*out, whole]


def _sample(docs: DataFrame, labels: DataFrame, wanted: list[str], sample: int, folds: int, key: str, text: str) -> DataFrame:
    """row, fold, words (distinct hashes) and the labels of at most `sample` labelled documents, written once."""
    known = labels.where(F.col(key).isNotNull() & F.col(wanted[-1]).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"y{i}") for i, c in enumerate(wanted)])
    known = saved(known.join(docs.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi").orderBy(F.xxhash64("_key"), "_key").limit(sample), "labelled")
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(known.select("_key")), "_key")  # `sample` keys at most
    one = texts.groupBy("_key").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))  # of rows that share a key one, in any order of arrival the same
    rows = one.join(F.broadcast(known), "_key").select(F.xxhash64("_key").alias("row"), "_text", *[f"y{i}" for i in range(len(wanted))])

    def run(batches):
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(1)):
                hashes, bounds = _hashed(data, offsets)
                sets = [np.unique(hashes[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                part = [c.slice(first, stop - first) for c in b.columns]
                yield pa.RecordBatch.from_arrays([part[0], lists, *part[2:]], names=["row", "words", *[f"y{i}" for i in range(len(wanted))]])

    made = rows.mapInArrow(run, "row long, words array<long>, " + ", ".join(f"y{i} int" for i in range(len(wanted))))
    return saved(made.withColumn("fold", F.pmod(F.xxhash64("row"), F.lit(folds)).cast("int")), "sample")


def _chosen(rows: DataFrame, n_labels: int, features: int, folds: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words, for each fold and last for all rows the positions of the chosen words, and of those most telling of the
    last label). Chi-squares are computed by Spark from counts by fold; `features` words for each set of rows, at
    most, reach the driver."""
    sums = [F.count(F.when(F.col("fold") == f, 1)).alias(f"n{f}") for f in range(folds)]
    sums += [F.sum(F.when(F.col("fold") == f, F.col(f"y{c}")).otherwise(0)).alias(f"p{c}_{f}") for c in range(n_labels) for f in range(folds)]
    whole = rows.agg(*sums).first()
    counts = saved(rows.select(F.explode("words").alias("word"), "fold", *[f"y{c}" for c in range(n_labels)]).groupBy("word").agg(*sums).where(" + ".join(f"n{f}" for f in range(folds)) + f" >= {MIN_DF}"), "counts")
    found: list[dict[int, float]] = []
    last: list[dict[int, float]] = []
    for held in [*range(folds), None]:
        part = [f for f in range(folds) if f != held]
        n = float(sum(whole[f"n{f}"] for f in part))
        df = sum((F.col(f"n{f}") for f in part), F.lit(0.0))
        best = F.lit(0.0)
        last.append({})
        for c in range(n_labels):
            positive = float(sum(whole[f"p{c}_{f}"] or 0 for f in part))
            if 0 < positive < n:
                expected = df * positive / n
                seen = sum((F.col(f"p{c}_{f}") for f in part), F.lit(0.0))
                chi = (seen - expected) ** 2 * n * n / F.greatest(expected * (n - df + 1) * (n - positive), F.lit(1e-9))
                best = F.greatest(best, chi)
                if c == n_labels - 1:
                    top = counts.select("word", F.when(seen > expected, chi).otherwise(0.0).alias("chi")).where(F.col("chi") >= CHI_SQUARE)
                    last[-1] = {r[0]: r[1] for r in top.orderBy(F.desc("chi"), "word").limit(features // 4).collect()}
        passed = counts.select("word", best.alias("chi"), df.alias("df")).where((F.col("chi") >= CHI_SQUARE) & (F.col("df") >= MIN_DF))
        found.append({r[0]: r[1] for r in passed.orderBy(F.desc("chi"), "word").limit(features).collect()})
    words = np.sort(np.array(sorted(set().union(*last, *found)), np.int64).view(np.uint64))
    place = lambda some: np.searchsorted(words, np.sort(np.array(list(some), np.int64).view(np.uint64)))
    return words, [place(s) for s in found], [place(s) for s in last]


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, label: str = "toxic", sample: int = SAMPLE, key: str = "doc_id", text: str = "text", features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the chain on a sample of at most `sample` labelled documents, those with the least hash of the key.

    A key that is labelled more than once counts as toxic if any of its labels is; null keys and labels are left out;
    of documents that share a key one is read. categories: columns of labels for the chain's beginning; those that
    the table lacks are left out, and a null in one counts as 0.
    """
    ship(docs.sparkSession)
    wanted = [*[c for c in categories if c in labels.columns], label]
    rows = _sample(docs, labels, wanted, sample, folds, key, text)
    words, chosen, telling = _chosen(rows, len(wanted), features, folds)
    hit = F.array_intersect("words", F.lit([int(w) for w in words.view(np.int64)]).cast("array<long>"))
    got = rows.select("row", "fold", *[f"y{c}" for c in range(len(wanted))], hit.alias("hit")).orderBy("row").toArrow()  # `sample` rows of (folds + 2) * features words at most
    given = np.stack([np.asarray(got.column(f"y{c}")) for c in range(len(wanted))], 1).astype(np.int8)
    lists = got.column("hit").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    present = np.zeros((got.num_rows, len(words)))
    if got.num_rows:
        sizes = np.asarray(lists.value_lengths())
        present[np.repeat(np.arange(got.num_rows), sizes), np.searchsorted(words, np.asarray(lists.flatten()).view(np.uint64))] = 1
    fold = np.asarray(got.column("fold"))
    labels_of = [np.hstack([given[:, :-1], kinds, given[:, -1:]]) for kinds in fold_kinds(present, given[:, -1], telling, fold)]
    return fit_chain(present, labels_of, [*wanted[:-1], *[f"{label}_{k + 1}" for k in range(KINDS)], label], words, chosen, fold)


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """docs with <prefix><category> for every category of the chain, from whole texts; a null or empty text has
    no words and gets the score of none. Columns of docs with such a name are replaced."""
    ship(docs.sparkSession)
    columns = [f"{prefix}{c}" for c in chain.names]
    docs = docs.drop(*columns)
    names, where = docs.columns, docs.columns.index(text)
    bits = np.uint64(64 - 16)

    def run(batches):
        table_of = np.zeros(1 << 16, bool)
        table_of[chain.words >> bits] = True
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(where)):
                hashes, bounds = _hashed(data, offsets)
                present = np.zeros((stop - first, len(chain.words)), np.float32)
                if len(chain.words):
                    at = np.flatnonzero(table_of[hashes >> bits])
                    word = np.minimum(np.searchsorted(chain.words, hashes[at]), len(chain.words) - 1)
                    same = chain.words[word] == hashes[at]
                    present[np.searchsorted(bounds, at[same], side="right") - 1, word[same]] = 1
                p = np.round(chain.score(present), 6)
                part = b.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=[*names, *columns])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, ", ".join([schema, *[f"`{c}` double" for c in columns]]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Category probabilities of every document, and whether it counts as toxic."""
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), chain).drop("text")
    return scored.withColumn("toxic", F.col("p_toxic") >= chain.threshold)
