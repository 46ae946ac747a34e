"""The prefix trie of conversations by partition refinement.

A conversation is a sequence of turns; conversations that begin alike share the nodes of their common turns. At first
all conversations are one class, the root. Round by round, the conversations of a class are split by their next turns;
the classes that come out are the nodes one level deeper. A class of one conversation is retired at once: the rest of
that conversation is a chain of nodes with one member each, which needs no more rounds. A conversation that ends
inside a class leaves it. The rounds stop when no class is left. Then the rounds are folded back from the deepest on:
what a node adds (itself as a leaf, saved tokens) goes to the nodes above it within the round, and the sum to the
class that the round started from.

A round takes a block of turns: one at first, and twice as many as the round before, up to LONGEST, so that long
common beginnings take few rounds. In a block, a conversation's turns are chained to digests of what it has said since
the block's start; a class is split by all of them at once. Turns are compared by the SHA-256 of role and text.

Nothing is gathered by conversation or class: turns are numbered in ranges (``scratch.numbered``), classes are counted
by aggregates that are combined in every task, and the digest of a node's ends is computed over a sorted stream of
blocks of ids, however many conversations are alike.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relforge.sources.scratch import numbered

from .shared import saved, ship, table

#: Turns of one round at most.
LONGEST = 64
#: Rows of fixed width (at most some 100 bytes) that are sent to every executor; more of them are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Ids whose text is joined to one block on the way to a digest.
IDS = 4_096
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    r, t = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256))


def rebuilt(table_of: DataFrame, group: int = 100, most: int = 6, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(c, d, digest, chars) for every turn d (from 1) of every rebuilt conversation c, and (c, len) for each of them.

    c begins with the first h turns of conversation c - c % group, h = crc32(c as text) % most (all if it has fewer,
    none if it is absent), and goes on with its own turns after its first h. Turns of equal number come in the order of
    their digests, null numbers first. Rows without a conversation belong to none and are left out.
    """
    slim = table_of.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("_turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"))
    placed = saved(numbered(slim, [F.asc_nulls_first("_turn"), F.col("digest")], "k", ["c"]).drop("_turn"), "placed")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    convs = saved(placed.groupBy("c").agg(F.max("k").alias("own")).withColumns({"h": h, "base": F.col("c") - F.col("c") % group}), "convs")
    lent = convs.select(F.col("c").alias("base"), F.least("own", F.lit(most - 1)).alias("lent"))
    convs = saved(convs.join(lent, "base", "left").withColumn("head", F.least("h", F.coalesce("lent", F.lit(0)))).select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "convs")
    first = placed.where(F.col("k") < most).select(F.col("c").alias("base"), "k", "digest", "chars")
    heads = convs.where("head > 0").select("c", "base", "head").join(first, "base").where("k <= head").select("c", F.col("k").alias("d"), "digest", "chars")
    tails = placed.join(convs.select("c", "h", "head"), "c").where("k > h").select("c", (F.col("k") - F.col("h") + F.col("head")).alias("d"), "digest", "chars")
    return saved(heads.unionByName(tails), "turns"), convs.select("c", "len")


def _beside(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with what is known of their class. Large tables are joined by a shuffle, where Spark splits a hot class."""
    return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts, on, how)


def _chained(digests: Column) -> Column:
    """For a list of structs of a digest: the digests of its beginnings."""
    none = F.lit(None).cast("array<binary>")
    step = lambda done, x: F.when(done.isNull(), F.array(x["digest"])).otherwise(F.concat(done, F.array(F.unhex(F.sha2(F.concat(F.element_at(done, -1), x["digest"]), 256)))))
    return F.aggregate(digests, none, step)


def _split(active: DataFrame, turns: DataFrame, depth: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, kept) of one round over the turns after `depth`, for active (c, len, class).

    nodes: d, node (its smallest member), parent, n_convs, chars, of the classes of two members or more. paths: node, d
    and above for each node and each node over it within the block. kept: c, len, class and at, the last shared node
    of every active conversation and its depth.
    """
    block = turns.where(F.col("d").between(depth + 1, depth + size)).join(active.select("c", "class"), "c")
    if size == 1:
        rows = block.select("c", "class", "d", F.col("digest").alias("p"), "chars")
    else:
        lists = block.groupBy("c", "class").agg(F.array_sort(F.collect_list(F.struct("d", "digest", "chars"))).alias("x"))  # `size` turns at most
        pairs = F.arrays_zip(F.col("x"), _chained(F.col("x")).alias("p"))
        rows = lists.select("c", "class", F.explode(pairs).alias("z")).select("c", "class", "z.x.d", "z.p", "z.x.chars")
    rows = saved(rows, "split")
    shared = saved(rows.groupBy("class", "d", "p").agg(F.min("c").alias("node"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")).where("n_convs > 1"), "shared")
    members = saved(_beside(rows.select("c", "class", "d", "p"), shared.select("class", "d", "p", "node"), ["class", "d", "p"]).select("c", "d", "node"), "members")
    last = saved(members.groupBy("c").agg(F.max(F.struct("d", "node")).alias("x")), "last")
    kept = active.join(last, "c", "left").select("c", "len", F.coalesce("x.node", "class").alias("class"), F.coalesce("x.d", F.lit(depth)).alias("at"))
    over = members.select(F.col("c").alias("node"), F.col("d").alias("e"), F.col("node").alias("above"))  # what a node's smallest member passes
    paths = saved(shared.select("node", "d", "class").join(over, "node").where("e <= d").select("node", "d", "class", "e", "above"), "paths")
    parents = paths.where("e = d - 1").select("node", "d", F.col("above").alias("parent"))
    nodes = shared.join(parents, ["node", "d"], "left").select("d", "node", F.coalesce("parent", "class").alias("parent"), "class", "n_convs", "chars")
    return saved(nodes, "nodes"), paths, saved(kept, "kept")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id (a node) and ends_sha256: the SHA-256 of the ids c that end there, as text, ascending, comma-joined.

    Ids are sorted in ranges of node and id, where each task joins up to IDS of one node to a block; the blocks of a
    node then pass one task in order, which holds one block and the running digest."""
    ship(ends.sparkSession)
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches):
        node, first, ids = None, None, []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["depth", "conv_id", "first", "ids"])

        for b in batches:
            for depth, conv, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if ids and ((depth, conv) != node or len(ids) >= IDS):
                    yield block()
                    ids = []
                if not ids:
                    node, first = (depth, conv), c
                ids.append(c)
        if ids:
            yield block()

    def digested(batches):
        node, running = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([running.hexdigest()], pa.string())], names=["depth", "conv_id", "ends_sha256"])

        for b in batches:
            for depth, conv, _, ids in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if (depth, conv) != node:
                    if node is not None:
                        yield row()
                    node, running = (depth, conv), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
        if node is not None:
            yield row()

    rows = ends.select("depth", "conv_id", "c").repartitionByRange(n, "depth", "conv_id", "c").sortWithinPartitions("depth", "conv_id", "c")
    blocks = saved(rows.mapInArrow(joined, "depth long, conv_id long, first long, ids string"), "ids")
    return blocks.repartition(n, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first").mapInArrow(digested, "depth long, conv_id long, ends_sha256 string")


def _folded(start: int, nodes: DataFrame, paths: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depth, conv_id, n_children, n_leaves, saved_tokens of the nodes of the round after depth `start`; class,
    n_children, n_leaves, saved_tokens that they add to the classes it started from). below: depth, conv_id,
    n_children, n_leaves and saved_tokens of what hangs on the nodes from later rounds and retired conversations."""
    kids = nodes.where(F.col("d") > start + 1).groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    more = below.select(F.col("depth").alias("d"), F.col("conv_id").alias("node"), F.col("n_children").alias("more"), "n_leaves", "saved_tokens")
    children = F.coalesce("kids", F.lit(0)) + F.coalesce("more", F.lit(0))
    leaves = F.coalesce("n_leaves", F.lit(0)) + F.when(children == 0, 1).otherwise(0)
    tokens = F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")
    own = nodes.join(kids, ["d", "node"], "left").join(more, ["d", "node"], "left")
    own = saved(own.select("d", "node", "class", children.alias("n_children"), leaves.alias("leaves"), tokens.alias("tokens")), "own")
    sums = paths.join(own.select("d", "node", "leaves", "tokens"), ["d", "node"]).groupBy(F.col("e").alias("d"), F.col("above").alias("node")).agg(F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
    totals = own.select("d", "node", "n_children").join(sums, ["d", "node"]).select(F.col("d").alias("depth"), F.col("node").alias("conv_id"), "n_children", "n_leaves", "saved_tokens")
    up = own.groupBy("class").agg(F.count(F.when(F.col("d") == start + 1, 1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("tokens").alias("saved_tokens"))
    return saved(totals, "totals"), up


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (see the fold) and ends_sha256.

    turns: c, d (from 1 on, without gaps), digest and chars (size of the turn's text); convs: c and len, one row each,
    those without turns too. Without conversations there are no nodes.
    """
    root = convs.agg(F.min("c").alias("root"), F.count("*").alias("n")).first()
    spark, names = turns.sparkSession, "depth long, conv_id long, n_children long, n_leaves long, saved_tokens long"
    final = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root["root"] is None:
        return spark.createDataFrame([], final)
    active = convs.select("c", "len", F.lit(root["root"]).alias("class"))
    rounds: list[tuple[int, DataFrame, DataFrame]] = []
    leave = convs.where("false").select("c", "len", F.lit(0).cast("long").alias("class"), F.lit(0).cast("long").alias("at"))
    if root["n"] == 1:
        leave, active = active.withColumn("at", F.lit(0).cast("long")), None
    depth, size = 0, 1
    while active is not None:
        nodes, paths, kept = _split(active, turns, depth, size)
        rounds.append((depth, nodes, paths))
        depth, size = depth + size, min(2 * size, LONGEST)
        going = (F.col("at") == depth) & (F.col("len") > depth)
        leave = leave.unionByName(kept.where(~going).select("c", "len", "class", "at"))
        active = kept.where(going).select("c", "len", "class")
        if active.isEmpty():
            active = None
    leave = saved(leave, "leave")
    retired = leave.where("len > at").select("c", "len", "at", "class")
    hanging = saved(retired.groupBy(F.col("at").alias("depth"), F.col("class").alias("conv_id")).agg(F.count("*").alias("n_children"), F.count("*").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")), "hanging")
    parts, up = [], spark.createDataFrame([], names)
    together = lambda x: x.groupBy("depth", "conv_id").agg(*[F.sum(k).alias(k) for k in ("n_children", "n_leaves", "saved_tokens")])
    for start, nodes, paths in reversed(rounds):
        totals, found = _folded(start, nodes, paths, together(hanging.unionByName(up)))
        parts.append(totals.join(nodes.select(F.col("d").alias("depth"), F.col("node").alias("conv_id"), "parent", "n_convs"), ["depth", "conv_id"]))
        up = saved(found.select(F.lit(start).cast("long").alias("depth"), F.col("class").alias("conv_id"), "n_children", "n_leaves", "saved_tokens"), "up")
    top = together(hanging.unionByName(up)).where("depth = 0")
    one = spark.createDataFrame([(0, root["root"], root["n"])], "depth long, conv_id long, n_convs long")
    zero = F.lit(0).cast("long")
    parts.append(one.join(top, ["depth", "conv_id"], "left").select("depth", "conv_id", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.lit(None).cast("long").alias("parent"), "n_convs"))
    shared = parts[0]
    for p in parts[1:]:
        shared = shared.unionByName(p)
    ends = end_digests(leave.where("len = at").select(F.col("at").alias("depth"), F.col("class").alias("conv_id"), "c"))
    shared = shared.join(ends, ["depth", "conv_id"], "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    ended = F.col("d") == F.col("len")
    chains = turns.select("c", "d").join(retired, "c").where("d > at")
    one = F.lit(1).cast("long")
    chains = chains.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("at") + 1, F.col("class")).otherwise(F.col("c")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(ended, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(ended, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH m AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM m),
o AS (SELECT c, list({'role': role, 'text': text} ORDER BY k) AS own FROM k GROUP BY c),
h AS (SELECT c, own, c - c % 100 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda r, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(r, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM o),
r AS (SELECT h.c, list_concat(CASE WHEN h.h > 0 THEN coalesce(b.own, [])[1:h.h] ELSE [] END, h.own[h.h + 1:]) AS t FROM h LEFT JOIN o b ON b.c = h.base),
p AS (SELECT c, len(t) AS len, d, t[1:d] AS p, t[d].text AS last FROM (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(length(coalesce(last, ''))) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '') AS ends FROM p GROUP BY d, p),
e AS (SELECT x.*, y.conv_id AS parent FROM n x LEFT JOIN n y ON x.d > 0 AND y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]),
g AS (SELECT x.d, x.p, count(*) FILTER (y.d = x.d + 1) AS n_children, sum((y.n_convs - 1) * y.chars) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM n z WHERE z.d = y.d + 1 AND z.p[1:y.d] = y.p)) AS n_leaves FROM n x JOIN n y ON y.d >= x.d AND y.p[1:x.d] = x.p GROUP BY x.d, x.p)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM e JOIN g USING (d, p)
"""
