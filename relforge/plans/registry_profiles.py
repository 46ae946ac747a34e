"""Queries over sketches, first values, medians and running profiles, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relforge.operators import profile, sketches
from relforge.sources.scratch import shared_dir

from .registry import COLUMNS, _sql_profile, query, raw

#: Tables with wide columns beside the relational ones.
_WIDE = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "pages": ["page_id", "url", "html"], "conversations": ["conv_id", "turn", "role", "text"]}
_ALL = COLUMNS | _WIDE


@query(" UNION ALL ".join(f"SELECT table_name, column_name, total_count, null_count, cardinality, total_count > 0 AND unique_count = total_count AS is_unique FROM ({_sql_profile(f'SELECT * FROM {t}', t, list(c))})" for t, c in _ALL.items()))
def sketched_profiles(spark, d):
    """What the rules ask of every column of all tables, from sketches wherever these are sure."""
    found = sketches.profile_all({t: raw(spark, d, t) for t in _ALL})
    return found.select("table_name", "column_name", "total_count", "null_count", "cardinality", "is_unique")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, true AS within FROM {t} HAVING count(*) > 0" for t, cs in _ALL.items() for c in cs))
def sketch_errors(spark, d):
    """Whether every estimate is within the sketch's error of the exact number, hashed values counted."""
    out = None
    for t in _ALL:
        df = raw(spark, d, t)
        both = sketches.estimated(sketches.sketch(df, t)).join(profile.column_counts(df, t).select("column_name", F.col("u").alias("exact")), "column_name")
        part = both.select("table_name", "column_name", (F.abs(F.col("u") - F.col("exact")) <= sketches.SURE * sketches.SKETCH_ERROR * F.col("exact") + 1).alias("within"))
        out = part if out is None else out.unionByName(part)
    return out


_FIRST = {"events": ("event_id", ["event_type", "value", "props"]), "orders": ("o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"]), "pages": ("page_id", ["url"])}


def _sql_first(table: str, key: str, column: str) -> str:
    rare = f"CASE WHEN {key} % 997 = 5 THEN {column} END" if column == "props" else column
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n, min({key}) AS first_key, max({key}) AS last_key, CAST(sum(length(CAST(v AS VARCHAR))) AS BIGINT) AS n_chars FROM (SELECT {key}, {rare} AS v FROM {table} WHERE {rare} IS NOT NULL ORDER BY {key} LIMIT 100)"


@query(" UNION ALL ".join(_sql_first(t, k, c) for t, (k, cs) in _FIRST.items() for c in cs if c not in ("o_totalprice", "value")))
def first_values(spark, d):
    """The first 100 values of every column in one scan of a table; a column with few values is looked for further."""
    out = None
    for t, (key, columns) in _FIRST.items():
        df = raw(spark, d, t)
        if "props" in columns:
            df = df.withColumn("props", F.when(F.col(key) % 997 == 5, F.col("props")))
        first = profile.first_values(df, columns, 100, [key])
        for c in (c for c in columns if c not in ("o_totalprice", "value")):
            at = F.when(F.col(c).isNotNull(), F.col("_o0"))
            part = first.agg(F.count(c).alias("n"), F.min(at).alias("first_key"), F.max(at).alias("last_key"), F.sum(F.length(c)).alias("n_chars")).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "*")
            out = part if out is None else out.unionByName(part)
    return out


_NUMBERS = [("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("orders", "o_custkey"), ("customer", "c_acctbal"), ("part", "p_size"), ("events", "value"), ("documents", "n_chars"), ("nation", "n_nationkey")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(median({c}) AS DOUBLE) AS median FROM {t}" for t, c in _NUMBERS))
def exact_medians(spark, d):
    """Medians by counts of ranges, of even and odd numbers of rows."""
    return spark.createDataFrame([(t, c, profile.exact_median(raw(spark, d, t), c)) for t, c in _NUMBERS], "table_name string, column_name string, median double")


@query("SELECT c AS column_name, CAST(3 AS BIGINT) AS batches, count(*) AS total_count, count(v) AS non_null_count, true AS within FROM (SELECT unnest(['event_type', 'user_id']) AS c, unnest([event_type, CAST(user_id AS VARCHAR)]) AS v FROM events) GROUP BY c")
def running_profiles(spark, d):
    """Three batches of the events, one of them delivered twice, give the profile of their union."""
    df = raw(spark, d, "events").select("event_id", "event_type", "user_id")
    store = f"{shared_dir(spark)}/relforge-running-{uuid.uuid4().hex}"
    for batch in (0, 1, 2, 1):
        sketches.add_batch(df.where(F.col("event_id") % 3 == batch).drop("event_id"), "events", str(batch), store)
    exact = profile.column_counts(df.drop("event_id"), "events").select("column_name", "u")
    found = sketches.running_profile(spark, store).join(exact, "column_name")
    return found.select("column_name", "batches", "total_count", "non_null_count", (F.abs(F.col("approx_unique_count") - F.col("u")) <= sketches.SURE * sketches.SKETCH_ERROR * F.col("u") + 1).alias("within"))
