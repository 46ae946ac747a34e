"""Tables in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local master gets a new folder on its own
    machine; on a cluster that would be another one for each executor, so there it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='relforge-')}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts the lineage.

    The table outlives lost executors; the folder's owner clears it with the other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relforge-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], name: str, group: list[str] | None = None, start: int = 1) -> DataFrame:
    """df with a first column that numbers the rows (of each group) from ``start``, in the order of ``by``.

    Rows go to ranges of the group and the order, are sorted there and written once with their range and their
    place in it; all numbers come from that one table. Rows that tie are spread by a last key of their own, so a
    range holds neither a whole large group nor all rows of one value. What a range adds to its places is the
    number of the group's rows in the ranges before: a row for each range, or for each group that a range holds.
    """
    spark = df.sparkSession
    group = group or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{g}`") for g in group]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *keys, *by, "_tie").sortWithinPartitions(*keys, *by, "_tie").drop("_tie")
    at = F.monotonically_increasing_id()  # the range above, the place in the sorted range below
    table = saved(ranged.withColumns({"_range": F.shiftrightunsigned(at, 33), "_place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = table.groupBy("_range", *group).agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    earlier = _before(sizes, group)
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    out = table.join(F.broadcast(earlier) if not group else earlier, same)
    number = F.col("_before") + F.col("_place") - F.col("_from") + F.lit(start)
    return out.select(number.cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def _before(sizes: DataFrame, group: list[str]) -> DataFrame:
    """_r (range), _g0, ... (group), _from (first place of the group there) and _before (its rows in earlier ranges).

    Ranges are in the order of the groups, so a group's ranges are neighbours: only its first, middle and last
    ranges are counted, a row for each range that it fills."""
    from pyspark.sql import Window

    order = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    named = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)]
    return sizes.select(F.col("_range").alias("_r"), *named, F.col("_first").alias("_from"), (F.sum("_size").over(order) - F.col("_size")).alias("_before"))
