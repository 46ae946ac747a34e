"""Profiles of growing tables: a stream of files is folded into running column counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_profile(spark: SparkSession, folder: str, schema, table: str, kind: str = "parquet") -> DataFrame:
    """table_name, column_name, total_count, non_null_count, approx_unique_count over all files that arrive in a
    folder; an output in complete mode. State is one HyperLogLog sketch for each column."""
    rows = spark.readStream.schema(schema).format(kind).load(folder)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in rows.columns])
    each = rows.select(F.explode(cells).alias("c")).select("c.*")
    return each.groupBy("column_name").agg(F.count("*").alias("total_count"), F.count("value").alias("non_null_count"), F.approx_count_distinct("value").alias("approx_unique_count")).select(F.lit(table).alias("table_name"), "*")
