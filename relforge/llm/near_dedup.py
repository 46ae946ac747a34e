"""Near-duplicate documents by b-bit MinHash.

Signatures: the minima of 320 hash functions over a document's distinct word shingles. Bands of five full
minima give candidate buckets; of each minimum two low bits stay, packed into longs, and the share of equal
fields, corrected for chance, estimates the similarity of a candidate pair by counting bits. Pairs whose
estimate is far below the threshold go; the rest are confirmed on the full shingle sets.

A bucket is not expanded into all pairs. Documents with equal sets are one class. The class of a bucket whose own
buckets are the most crowded, the centre of a group as a rule, is compared with the bucket's other classes first;
then the rest in the order of a hash, which places them like ranks without sorting a bucket anywhere. A round
compares the next places (0, 16, 256, ...) with all later ones, confirms the pairs and joins components; a pair
already in one component needs no test, and a bucket whose rest is one component is done. After the first round,
documents whose own unshared shingles rule out any link are done too. So a group of n near copies costs about n
pairs, yet no pair that shares a bucket is left undecided. Buckets are counted by aggregates and met by joins, whose
large partitions Spark splits; no step needs a whole bucket in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, mixed, run_hashes, word_bounds, word_hashes
from .shared import saved, ship, table, text_slices

BANDS, ROWS, BITS = 32, 5, 2
#: The first BANDS * ROWS minima also make the bands.
HASHES = 320
#: Standard deviations of the estimate at the threshold by which a pair may fall short and still be confirmed.
SLACK = 4.5
BROADCAST_IDS = 2_000_000
#: A round takes so many times the places of the one before.
GROWTH = 16
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_FIELDS = 64 // BITS
_LONGS = -(-HASHES // _FIELDS)

_seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_MULTIPLY, _FLIP = _seeds[:HASHES] | np.uint64(1), _seeds[HASHES:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted shingle hashes row after row, hashes before each row).

    A row with fewer than k words has its whole sequence as one shingle, a row without words none.
    """
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, IS_WORD)
    words = word_hashes(data, starts, ends)
    runs = {k: run_hashes(words, k)}
    sets = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        n = min(k, hi - lo)
        if n not in runs and n:
            runs[n] = run_hashes(words, n)
        sets.append(np.unique(runs[n][lo : hi - n + 1]) if n else words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.cumsum([0, *map(len, sets)])


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x HASHES minima (32 bits); rows must not be empty."""
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    step = 1 << 15
    firsts = np.searchsorted(bounds, np.arange(0, bounds[-1], step), side="right") - 1
    out[:] = np.iinfo(np.uint32).max
    for at, row in zip(range(0, int(bounds[-1]), step), firsts.tolist(), strict=True):
        piece = hashes[at : at + step]
        last = int(np.searchsorted(bounds, at + len(piece), side="left"))
        cuts = np.maximum(bounds[row:last] - at, 0)
        for p in range(HASHES):
            low = np.minimum.reduceat((((piece ^ _FLIP[p]) * _MULTIPLY[p]) >> np.uint64(32)).astype(np.uint32), cuts)
            np.minimum(out[row:last, p], low, out=out[row:last, p])
    return out


def _prints(hashes: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """A 128-bit fingerprint of each row's set, as two columns."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes ^ np.uint64(s)))]) for s in (0x51, 0xA7)]
    return [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]


def signatures(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """id, n (set size), fa and fb (a 128-bit fingerprint of the set), sig (packed low bits) and bands."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for first, stop, data, offsets in text_slices(b.column(1), max_rows=1_024):
                hashes, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                low = minima(hashes, np.concatenate([bounds[:-1][full], bounds[-1:]])) if len(full) else np.zeros((0, HASHES), np.uint32)
                keys = np.full((len(full), BANDS), np.arange(BANDS, dtype=np.uint64))
                for r in range(ROWS):
                    keys = mixed(keys ^ low[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(r << 40))
                fields = np.zeros((len(full), _LONGS * _FIELDS), np.uint64)
                fields[:, :HASHES] = low & np.uint32((1 << BITS) - 1)
                packed = np.bitwise_or.reduce(fields.reshape(len(full), _LONGS, _FIELDS) << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                at = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), pa.int64(), mask=n == 0)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())).take(at) if len(full) else pa.nulls(len(n), pa.list_(pa.int64())) for x in (packed, keys)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), pa.array(n, pa.int64()), *_prints(hashes, bounds), *lists], names=["id", "n", "fa", "fb", "sig", "bands"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n long, fa long, fb long, sig array<long>, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """fa, fb, items: the fingerprint and the full set of each text (a single column)."""

    def run(batches):
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                hashes, bounds = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([*_prints(hashes, bounds), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))], names=["fa", "fb", "items"])

    return texts.mapInArrow(run, "fa long, fb long, items array<long>")


def _equal_fields(a: str, b: str):
    """How many of the packed fields of two signatures agree."""
    differ = None
    for j in range(_LONGS):
        x = F.col(f"{a}.sig")[j].bitwiseXOR(F.col(f"{b}.sig")[j])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    return F.lit(HASHES) - differ


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of edges (a, b): the smallest vertex that it reaches.

    Each pass takes the least root among a vertex and its neighbours and then follows roots once more, so
    that long chains halve; vertices with many edges are pre-aggregated.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = saved(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.v).groupBy("a").agg(F.min("root").alias("near"))
        step = saved(roots.join(saved(near, "near"), roots.v == F.col("a")).select("v", "root", F.least("root", "near").alias("new")), "step")
        jump = step.select(F.col("v").alias("w"), F.col("new").alias("far"))
        step = saved(step.join(jump, step.new == jump.w, "left").select("v", "root", F.least("new", F.coalesce("far", "new")).alias("new")), "roots")
        roots = step.select("v", F.col("new").alias("root"))
        if step.where("new <> root").isEmpty():
            return roots


_PAIR = ["xa", "xb", "x", "ya", "yb", "y"]


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """a, b (keys): the pairs of classes (fingerprints xa, xb and ya, yb, keys x and y) whose full sets are similar."""
    pairs = pairs.select(*_PAIR).distinct()
    both = F.size(F.array_intersect("p", "q"))
    found = pairs.join(sets.select(F.col("fa").alias("xa"), F.col("fb").alias("xb"), F.col("items").alias("p")), ["xa", "xb"])
    found = found.join(sets.select(F.col("fa").alias("ya"), F.col("fb").alias("yb"), F.col("items").alias("q")), ["ya", "yb"])
    close = found.where(both * 100 >= (F.size("p") + F.size("q") - both) * threshold_percent)
    return saved(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")


def _open(live: DataFrame, roots: DataFrame) -> DataFrame:
    """live with the present roots, without the buckets that are one component."""
    rooted = live.drop("root").join(roots, F.col("rep") == F.col("v"), "left").withColumn("root", F.coalesce("root", "rep")).drop("v")
    rooted = saved(rooted, "rooted")
    mixed_bands = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return saved(rooted.join(saved(mixed_bands, "mixed"), "band", "left_semi"), "open")


def _linkable(live: DataFrame, sets: DataFrame, threshold_percent: int) -> DataFrame:
    """live with ``common``, a bound on what any two documents share: the shingles that stand in another document
    of an open bucket as well. A document whose bound is too low for every partner of its bucket's least size can
    have no link there and goes."""
    items = sets.join(live.select("fa", "fb").distinct(), ["fa", "fb"], "left_semi").select("fa", "fb", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count("*").alias("n"), F.min("fa").alias("fa"), F.min("fb").alias("fb")).where("n = 1").groupBy("fa", "fb").agg(F.count("*").alias("alone"))
    least = saved(live.groupBy("band").agg(F.min("n").alias("least")), "least")
    bound = live.join(saved(alone, "alone"), ["fa", "fb"], "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    smallest = F.greatest("least", "common")
    return bound.join(least, "band").where((F.col("common") * 100) >= (smallest + F.col("n") - F.col("common")) * threshold_percent).drop("least")


def _buckets(classes: DataFrame) -> DataFrame:
    """A row for each class in each bucket that it shares: band, fa, fb, n, rep, place (where a hash puts it among
    the bucket's classes) and c_fa, c_fb, c_n, c_rep (the bucket's central class)."""
    each = classes.select("fa", "fb", "n", "rep", F.explode("bands").alias("band"))
    crowds = saved(each.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowds")
    buckets = saved(each.join(crowds, "band"), "buckets")
    central = saved(buckets.groupBy("fa", "fb").agg(F.sum("crowd").alias("central")), "central")
    graded = saved(buckets.join(central, ["fa", "fb"]), "graded")
    top = F.max(F.struct("central", "fa", "fb", "n", "rep"))
    centres = graded.groupBy("band").agg(top.alias("c")).select("band", *[F.col(f"c.{k}").alias(f"c_{k}") for k in ("fa", "fb", "n", "rep")])
    share = F.col("fa").bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(float(1 << 63))
    return saved(graded.join(saved(centres, "centres"), "band").withColumn("place", F.floor(share * F.col("crowd"))).drop("crowd", "central"), "members")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold_percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: its key, n_shingles, component_id (the smallest key reachable over links,
    its own included) and kept (key = component_id).

    A link joins documents with 100 * intersection >= threshold_percent * union of their sets of distinct word
    shingles. Words are split at white space (ASCII) after lower-casing A-Z. Null and empty texts have empty
    sets and are linked with nothing. Rows with a null key are kept, with a null component_id. Rows that share a key
    are one document: each has the n_shingles of its own text, and a link of one of them is a link of the key.
    Other columns are ignored.

    A pair at exactly 80 percent shares no band with probability 3e-6 and is confirmed unless its estimate is
    SLACK standard deviations low. Sets are compared as sets of 64-bit shingle hashes.
    """
    share = threshold_percent / 100
    equal = share + (1 - share) / 2**BITS
    least_equal = HASHES * (equal - SLACK * (equal * (1 - equal) / HASHES) ** 0.5)
    signed = saved(signatures(docs, shingle, key, text), "signatures")
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = saved(full.groupBy("n", "fa", "fb").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    members = _buckets(classes)
    repeated = saved(full.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated")
    shared_keys = not repeated.isEmpty()
    links, roots = members.where("false").select(F.col("rep").alias("a"), F.col("rep").alias("b")), members.where("false").select(F.col("rep").alias("v"), F.col("rep").alias("root"))
    if shared_keys:  # all classes of one key
        of_key = saved(full.join(repeated, "id", "left_semi").join(classes.select("n", "fa", "fb", "rep"), ["n", "fa", "fb"]).select("id", "rep").distinct(), "of_key")
        links = saved(of_key.join(of_key.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "links")
        roots = components(links)
    if not members.isEmpty():
        inside = saved(members.select("fa", "fb", "rep").distinct(), "inside")
        ids, n_inside = inside.select(F.col("rep").alias("id")).distinct(), inside.count()
        texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids) if n_inside <= BROADCAST_IDS else ids, "id", "left_semi").select("text")
        sets = _sets(texts, shingle)
        if shared_keys:  # rows of one key may have equal sets, or sets of other classes
            sets = sets.join(inside.select("fa", "fb"), ["fa", "fb"], "left_semi").dropDuplicates(["fa", "fb"])
        sets = saved(sets, "sets")
        marks = classes.select("fa", "fb", "sig", "bands")
        alike = _equal_fields("p", "m") >= least_equal
        sizes = F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * threshold_percent
        others = members.where("NOT (fa = c_fa AND fb = c_fb)")
        pairs = others.where((F.col("rep") != F.col("c_rep")) & sizes).select(F.col("c_fa").alias("xa"), F.col("c_fb").alias("xb"), F.col("c_rep").alias("x"), F.col("fa").alias("ya"), F.col("fb").alias("yb"), F.col("rep").alias("y")).distinct()
        p, m = marks.alias("p"), marks.alias("m")
        pairs = pairs.join(p, (F.col("xa") == F.col("p.fa")) & (F.col("xb") == F.col("p.fb"))).join(m, (F.col("ya") == F.col("m.fa")) & (F.col("yb") == F.col("m.fb"))).where(alike)
        links = links.unionByName(_confirmed(pairs, sets, threshold_percent))
        roots = components(links)
        live = _open(others.select("band", "fa", "fb", "n", "rep", "place"), roots)
        if not live.isEmpty():
            live = _open(_linkable(live, sets, threshold_percent).join(marks, ["fa", "fb"]), roots)
        first, after = 0, GROWTH
        while not live.isEmpty():
            p, m = live.where(F.col("place").between(first, after - 1)).alias("p"), live.alias("m")
            most = F.least("p.common", "m.common")  # of the intersection
            near = (most * 100 >= (F.col("p.n") + F.col("m.n") - most) * threshold_percent) & alike
            # a pair counts in the first of its common buckets only
            here = F.element_at(F.array_intersect("p.bands", "m.bands"), 1) == F.col("p.band")
            later = F.struct("p.place", "p.fa", "p.fb") < F.struct("m.place", "m.fa", "m.fb")
            pairs = m.join(p, (F.col("p.band") == F.col("m.band")) & later & (F.col("p.root") != F.col("m.root")) & near & here)
            new = _confirmed(pairs.select(*[F.col(f"{s}.{c}").alias(n) for (s, c), n in zip([(s, c) for s in "pm" for c in ("fa", "fb", "rep")], _PAIR, strict=True)]), sets, threshold_percent)
            if not new.isEmpty():
                links = links.unionByName(new)
                roots = components(links)
            live = _open(live.where(F.col("place") >= after), roots)
            first, after = after, after * GROWTH
    named = saved(classes.join(roots, classes.rep == roots.v, "left").select("n", "fa", "fb", F.coalesce("root", "rep").alias("component_id")), "named")
    out = signed.select("id", "n", "fa", "fb").join(named, ["n", "fa", "fb"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
f AS (SELECT doc_id, unnest(g) AS h FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM f x JOIN f y USING (h) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v AND reach.r < e.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = n.doc_id
"""
