"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to cells of a fixed ring; each shard owns many virtual nodes on it. A cell's rows go to the next
virtual node clockwise; where its shard has reached its capacity they go on clockwise to the next shard with
room. Only the counts of the cells (at most ``cells`` of them, whatever the number of rows) reach the driver,
which fills the shards; a row then finds its place by its rank within its cell. Ranks come from ranges of the rows
(``scratch.numbered``), so a key that a third of all rows share is spread over tasks. Native DataFrame code only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relforge.sources.scratch import numbered

CELLS = 1 << 14
VIRTUAL_NODES = 64


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()) % cells
    return sorted((place(s, v), s) for s in range(n_shards) for v in range(virtual_nodes))


def capacities(n_rows: int, n_shards: int, load_factor: float) -> list[int]:
    """Rows that each shard takes at most; at factor 1 they add up to n_rows and differ by one at most."""
    if load_factor <= 1:
        return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    return [ceil(load_factor * n_rows / n_shards)] * n_shards


def fill(counts: dict[int, int], n_shards: int, load_factor: float, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, slot of the first) for every run of rows of a cell."""
    room = capacities(sum(counts.values()), n_shards, load_factor)
    used, cells, after = [0] * n_shards, [c for c, _ in nodes], list(range(len(nodes)))

    def open_node(i: int) -> int:
        """The first virtual node from i on, clockwise, whose shard has room."""
        passed = []
        while True:
            i %= len(nodes)
            if after[i] != i:
                passed.append(i)
                i = after[i]
            elif used[nodes[i][1]] >= room[nodes[i][1]]:
                passed.append(i)
                after[i] = (i + 1) % len(nodes)
            else:
                for p in passed:
                    after[p] = i
                return i

    runs = []
    for cell in sorted(counts):
        rank, left, i = 0, counts[cell], bisect_left(cells, cell)
        while left:
            i = open_node(i)
            shard = nodes[i][1]
            take = min(left, room[shard] - used[shard])
            runs.append((cell, rank, rank + take, shard, used[shard]))
            used[shard] += take
            rank, left = rank + take, left - take
    return runs


def assign(df: DataFrame, key: str, n_shards: int, tie_columns: list[str], load_factor: float = 1.0, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """df with ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    At load_factor 1 the counts of the shards differ by one at most; above 1 a shard takes at most that
    multiple of the mean, and fewer rows leave their own arc. Rows with equal keys share a cell and are ranked
    by tie_columns; equal rows are interchangeable. A null key hashes by its tie_columns, so that many of
    them spread over the ring. An empty table gives an empty table. df's columns ``shard``, ``slot`` and those
    that start with ``_ring`` are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", *[c for c in df.columns if c.startswith("_ring")])
    hashed = F.when(F.col(key).isNull(), F.xxhash64(F.lit(-1), *tie_columns)).otherwise(F.xxhash64(key))
    placed = df.withColumn("_ring_hash", hashed).withColumn("_ring_cell", F.pmod("_ring_hash", F.lit(cells)).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy("_ring_cell").count().collect()}
    runs = fill(counts, n_shards, load_factor, ring(n_shards, virtual_nodes, cells))
    by_cell: dict[int, list] = {}
    for cell, *run in runs:
        by_cell.setdefault(cell, []).append(tuple(run))
    plan = spark.createDataFrame(list(by_cell.items()), "_ring_cell int, _ring_runs array<struct<first:long,stop:long,shard:int,slot:long>>")
    ranked = numbered(placed, [F.col("_ring_hash"), F.col(key), *map(F.col, tie_columns)], "_ring_rank", ["_ring_cell"], start=0)
    found = F.filter("_ring_runs", lambda r: (r["first"] <= F.col("_ring_rank")) & (F.col("_ring_rank") < r["stop"]))[0]
    return (
        ranked.join(F.broadcast(plan), "_ring_cell")  # at most `cells` rows and a run for each shard that fills up
        .withColumn("_ring_run", found)
        .withColumns({"shard": F.col("_ring_run.shard"), "slot": F.col("_ring_run.slot") + F.col("_ring_rank") - F.col("_ring_run.first")})
        .drop("_ring_cell", "_ring_hash", "_ring_rank", "_ring_runs", "_ring_run")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under law ``rows``: counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(rows, "doc_id", 40, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
