"""Profiles from sketches first: exact counts only where a rule could go either way.

One aggregate of a table gives rows, non-nulls and a HyperLogLog sketch of every column; no value moves. The sketch's
standard error is SKETCH_ERROR, and a rule's limit that is more than SURE errors away from the estimate is decided by
it. Columns nearer to a limit, above all those that may be unique, are counted exactly, by 128-bit hashes of their
values, so that a wide column never moves either.

Running profiles keep the sketches of every batch in a table, so that batches of a stream or of days merge to the
profile of their union; a batch that comes again replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.functions import inference
from relforge.sources.catalog import ROW_ORDER, plain

from .profile import _counted, _value_groups

#: lgK of the sketches, their relative standard error (1.04 / sqrt(2**lgK)), and the errors that make a limit sure.
LG_K, SKETCH_ERROR, SURE = 14, 0.0082, 5
#: Limits of the rules: distinct values as such, and as shares of all rows.
COUNT_LIMITS, SHARE_LIMITS = (10, 50), (0.01, 0.02, 0.05, 0.5, 0.7, 0.9, 0.95, 1.0)


def _q(c: str):
    return F.col(f"`{c}`")


def sketch(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, n, k (non-nulls) and sketch of every column, in one aggregate."""
    df = plain(df.drop(ROW_ORDER))
    values = {c: _q(c) if t in ("int", "bigint", "string", "binary") else _q(c).cast("string") for c, t in df.dtypes}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(_q(c)).alias(f"k{i}"), F.hll_sketch_agg(values[c], F.lit(LG_K)).alias(f"s{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), "n", F.col(f"k{i}").alias("k"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select(F.lit(table).alias("table_name"), "r.*")


def estimated(sketches: DataFrame) -> DataFrame:
    """table_name, column_name, n, k, u (estimated distinct values) and sure: whether every limit of the rules is SURE
    errors away, so that the exact number would be judged alike."""
    n, k = F.col("n"), F.col("k")
    u = F.least(F.hll_sketch_estimate("sketch"), k)
    got = sketches.select("table_name", "column_name", "n", "k", u.alias("u"))
    slack = F.lit(SURE * SKETCH_ERROR)
    limits = [*[F.lit(float(x)) for x in COUNT_LIMITS], *[n * x for x in SHARE_LIMITS]]
    near = F.lit(False)
    for limit in limits:
        near = near | (F.abs(F.col("u") - limit) <= slack * limit + 1)
    return got.withColumn("sure", ~near | (k == 0))


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, total_count, null_count, non_null_count, unique_count, null_ratio, uniqueness_ratio,
    cardinality, is_unique and is_exact (whether unique_count was counted, not estimated) of all columns.

    cardinality and is_unique are those of exact counts: estimates near a limit are not used.
    """
    first = None
    for name, df in sorted(tables.items()):
        part = sketch(df, name)
        first = part if first is None else first.unionByName(part)
    known = estimated(first).collect()  # a row for each column
    exact, spark = None, next(iter(tables.values())).sparkSession
    unsure: dict[str, dict[str, tuple[int, int, int]]] = {}
    for r in known:
        if not r["sure"]:
            unsure.setdefault(r["table_name"], {})[r["column_name"]] = (r["n"], r["k"], r["u"])
    for name, columns in unsure.items():
        part = _value_groups(tables[name].select(*map(_q, columns)), name, columns)
        exact = part if exact is None else exact.unionByName(part)
    rows = spark.createDataFrame([tuple(r) for r in known], "table_name string, column_name string, n long, k long, u long, sure boolean")
    if exact is not None:
        counted = _counted(exact).select("table_name", "column_name", F.col("u").alias("counted"))
        rows = rows.join(F.broadcast(counted), ["table_name", "column_name"], "left")  # a row for each column
    else:
        rows = rows.withColumn("counted", F.lit(None).cast("long"))
    u = F.coalesce("counted", "u")
    ratio = lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))
    return rows.select(
        "table_name", "column_name", F.col("n").alias("total_count"), (F.col("n") - F.col("k")).alias("null_count"), F.col("k").alias("non_null_count"), u.alias("unique_count"), ratio(F.col("n") - F.col("k")).alias("null_ratio"),
        ratio(u).alias("uniqueness_ratio"), inference.cardinality(u, F.col("n")).alias("cardinality"), ((u == F.col("n")) & (F.col("k") == F.col("n")) & (F.col("n") > 0) & F.col("counted").isNotNull()).alias("is_unique"), F.col("counted").isNotNull().alias("is_exact"),
    )


# Running profiles


def add_batch(df: DataFrame, table: str, batch: str, store: str) -> None:
    """Adds a batch's sketches to the running profile in the folder `store`; one with the same name is replaced, so a
    batch that is delivered again counts once. Each batch is a partition that is written by itself."""
    sketch(df, table).drop("table_name").write.mode("overwrite").parquet(f"{store.rstrip('/')}/table_name={table}/batch={batch}")


def running_profile(spark: SparkSession, store: str) -> DataFrame:
    """table_name, column_name, batches, total_count, non_null_count and approx_unique_count over all batches."""
    kinds = "column_name string, n long, k long, sketch binary, table_name string, batch string"
    try:
        stored = spark.read.schema(kinds).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], kinds)
    return stored.groupBy("table_name", "column_name").agg(F.count("*").alias("batches"), F.sum("n").alias("total_count"), F.sum("k").alias("non_null_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_unique_count"))
