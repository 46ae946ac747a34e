"""Column profiles: counts, cardinality, types, shapes of text. One aggregate per table, rows stay in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from relforge.functions import inference, naming
from relforge.functions.hashing import wide_hash
from relforge.sources.catalog import ROW_ORDER, plain
from relforge.sources.scratch import saved

SAMPLE = 100
ADDRESS_SAMPLE = 50
JSON_SAMPLE = 10
FIRST_VALUES = 5
#: Rows that are looked at for first values, and ranges of one pass for a median.
HEAD_ROWS, RANGES = 1_000, 1_024
#: Distinct values that a task may count as it reads them, that a task gets of a column with more, and rows among which
#: repeated ones are dropped before they move.
FEW_VALUES, VALUES_IN_A_TASK, HELD_ROWS = 1_000_000, 500_000, 500_000
#: Types whose values are no wider than a hash.
_NARROW = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ORDER]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def column_counts(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, n, k (non-null), u (distinct): a row for each column.

    A first look (see ``first_look``) tells rows and non-nulls; then distinct values are counted, wide ones as 128-bit
    hashes, and no row is expanded. See ``sketches.profile_all`` for a first look that moves nothing.
    """
    return _counted(_value_groups(df, table, first_look({table: df})[table]))


def first_look(tables: dict[str, DataFrame]) -> dict[str, dict[str, tuple[int, int, int]]]:
    """Rows, non-nulls and about how many distinct values every column of every table has, in one job that moves a
    row for each task."""
    out = None
    for name, df in tables.items():
        df = plain(df.drop(ROW_ORDER))
        aggs = [F.struct(F.lit(c).alias("c"), F.count("*").alias("n"), F.count(_q(c)).alias("k"), F.approx_count_distinct(_q(c)).alias("u")) for c in df.columns]
        part = df.agg(F.array(*aggs).alias("r")).select(F.lit(name).alias("t"), F.inline("r"))
        out = part if out is None else out.unionByName(part)
    found: dict[str, dict[str, tuple[int, int, int]]] = {t: {} for t in tables}
    for r in out.collect() if out is not None else []:  # a row for each column
        found[r["t"]][r["c"]] = (r["n"], r["k"], r["u"])
    return found


def _value_groups(df: DataFrame, table: str, known: dict[str, tuple[int, int, int]]) -> DataFrame:
    """table_name, column_name, n, k, u: a row with the rows and non-nulls of each column, and one (0, 0, 1) for each of
    its distinct values. known: of each column rows, non-nulls and about how many distinct values it has.

    Values of columns with FEW_VALUES at most are counted where they are read. Those of others, which may be any
    number, go to tasks of VALUES_IN_A_TASK, whatever they compress to; before, repeated values are dropped among
    HELD_ROWS at a time, so a frequent value is few rows and no task's memory follows the table's size.
    """
    df = plain(df.drop(ROW_ORDER))
    out = df.sparkSession.createDataFrame([(table, c, *known[c][:2], 0) for c in df.columns], "table_name string, column_name string, n long, k long, u long")
    for f in df.schema:
        key = [_q(f.name).alias("g0")] if isinstance(f.dataType, _NARROW) else wide_hash([_q(f.name)])
        values = df.where(_q(f.name).isNotNull()).select(*key)
        if known[f.name][2] > FEW_VALUES:
            tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-known[f.name][2] // VALUES_IN_A_TASK))
            values = values.mapInArrow(_fewer(HELD_ROWS), values.schema).repartition(tasks, *values.columns)
        out = out.unionByName(values.distinct().select(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(1).cast("long").alias("u")))
    return out


def _fewer(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for the different rows among so many at a time; it goes to the tasks by value, without this package."""

    def run(batches):
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.num_rows
            if held and (b is None or size >= most):
                whole = pa.Table.from_batches(held)
                yield from whole.group_by(whole.column_names, use_threads=False).aggregate([]).to_batches()
                held, size = [], 0

    return run


def _counted(groups: DataFrame) -> DataFrame:
    return groups.groupBy("table_name", "column_name").agg(*[F.sum(x).alias(x) for x in ("n", "k", "u")])


def profiles_of(counts: DataFrame) -> DataFrame:
    ratio = lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(F.lit(0.0))
    return counts.select(
        "table_name", "column_name", F.col("n").alias("total_count"), (F.col("n") - F.col("k")).alias("null_count"), F.col("k").alias("non_null_count"),
        F.col("u").alias("unique_count"), ratio(F.col("n") - F.col("k")).alias("null_ratio"), ratio(F.col("u")).alias("uniqueness_ratio"), inference.cardinality(F.col("u"), F.col("n")).alias("cardinality"),
    )


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """table_name, column_name, total_count, null_count, non_null_count, unique_count, null_ratio,
    uniqueness_ratio (of all rows; 0 for an empty table) and cardinality, a row for each column."""
    return profiles_of(column_counts(df, table))


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    """The column profiles of all tables, in one job after the first look."""
    out, known = None, first_look(tables)
    for name, df in sorted(tables.items()):
        part = _value_groups(df, name, known[name])
        out = part if out is None else out.unionByName(part)
    return profiles_of(_counted(out))


def samples(df: DataFrame, column: str, n: int, order: list[str]) -> DataFrame:
    """value: the first n non-null values of a column, as text, in the given order."""
    kind = dict(df.dtypes)[column]
    value = F.to_json(_q(column)) if kind.startswith(("array", "map", "struct")) else _q(column).cast("string")
    return df.where(_q(column).isNotNull()).orderBy(*[_q(o) for o in order]).limit(n).select(value.alias("value"), *[_q(o).alias(f"_o{i}") for i, o in enumerate(order)])


def first_values(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    """A small table of the first n non-null values of every column, as text, in the given order; a cell beyond a
    column's first n is null. _o0, ... are the values of the order.

    One scan takes the first HEAD_ROWS rows of all columns together, which a heap in every task bounds. Only columns
    that have fewer than n values among them are looked for further, each by itself.
    """
    kinds = dict(df.dtypes)
    text = {c: F.to_json(_q(c)) if kinds[c].startswith(("array", "map", "struct")) else _q(c).cast("string") for c in columns}
    keys = [_q(o).alias(f"_o{i}") for i, o in enumerate(order)]
    head = saved(df.orderBy(*map(_q, order)).limit(max(HEAD_ROWS, n)).select(*keys, *[text[c].alias(f"v{i}") for i, c in enumerate(columns)]), "head")
    sizes = head.agg(F.count("*").alias("rows"), *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    run = Window.orderBy(*[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)  # HEAD_ROWS rows
    counted = head.select("*", *[F.count(f"v{i}").over(run).alias(f"k{i}") for i in range(len(columns))])
    whole = sizes["rows"] < max(HEAD_ROWS, n)
    full = [whole or sizes[f"n{i}"] >= n for i in range(len(columns))]
    blank = F.lit(None).cast("string")
    out = counted.select(*[f"_o{i}" for i in range(len(order))], *[(F.when(F.col(f"k{i}") <= n, F.col(f"v{i}")) if full[i] else blank).alias(c) for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        if not full[i]:
            out = out.unionByName(samples(df, c, n, order).withColumnRenamed("value", c), allowMissingColumns=True)
    return out


def sample_values(df: DataFrame, table: str, columns: list[str], order: list[str], n: int = FIRST_VALUES) -> DataFrame:
    """table_name, column_name, position (from 1), value."""
    first = first_values(df, columns, n, order)
    at = [f"_o{i}" for i in range(len(order))]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).alias("value")) for c in columns])
    each = first.select(*at, F.explode(cells).alias("x")).select(*at, "x.*").where("value IS NOT NULL")
    position = F.row_number().over(Window.partitionBy("column_name").orderBy(*at)).cast("long")  # n rows of a column
    return each.select(F.lit(table).alias("table_name"), "column_name", position.alias("position"), "value")


def multivalued(df: DataFrame, table: str, columns: list[str], order: list[str], mode: str = "textbook", share: float = 0.3) -> DataFrame:
    """table_name, column_name, is_multivalued: whether more than `share` of the first 100 values hold the same
    separator, or a bracketed list. In ``textbook`` mode columns of dates, times and URLs' schemes are no lists."""
    aggs = []
    for i, c in enumerate(columns):
        v = _q(c)
        n = F.count(v)
        hits = [F.count(F.when(F.contains(v, F.lit(d)), 1)) > n * share for d in inference.DELIMITERS]
        hits.append(F.count(F.when(v.rlike(r"[\[\{].*[\]\}]"), 1)) > n * share)
        dates = F.coalesce(F.bool_and(F.when(v.isNotNull(), inference.parses_as_date(v))), F.lit(False)) if mode == "textbook" else F.lit(False)
        aggs.append((F.greatest(*hits) & ~dates).alias(f"b{i}"))
    got = first_values(df, columns, SAMPLE, order).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").alias("is_multivalued")) for i, c in enumerate(columns)])
    return got.select(F.explode(rows).alias("r")).select(F.lit(table).alias("table_name"), "r.*")


def oracle_types(df: DataFrame, table: str, order: list[str] | None = None, mode: str = "textbook") -> DataFrame:
    """table_name, column_name, oracle_type. Dates are told from the first 100 values in the given order (by
    default every value has to parse). ``compat`` counts a null as three characters of text."""
    df = plain(df)
    fields = [f for f in df.schema if f.name != ROW_ORDER]
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        c = _q(f.name)
        text = c.cast("string")
        longest = F.max(F.length(text))
        if mode == "compat":
            longest = F.greatest(longest, F.when(F.count("*") > F.count(c), 3))
        is_text = isinstance(f.dataType, StringType)
        aggs += [
            F.count(c).alias(f"k{i}"),
            (F.max(c).cast("double") if isinstance(f.dataType, NumericType) else F.lit(None).cast("double")).alias(f"max{i}"),
            F.coalesce(longest, F.lit(0)).alias(f"len{i}"),
            (F.coalesce(F.bool_and(F.when(c.isNotNull(), inference.parses_as_date(text))), F.lit(False)) if is_text and order is None else F.lit(False)).alias(f"date{i}"),
            (F.coalesce(F.bool_and(F.when(c.isNotNull(), F.lower(text).isin(inference.BOOLEAN_TEXTS))), F.lit(False)) if is_text else F.lit(False)).alias(f"bool{i}"),
        ]
    got = df.agg(*aggs)
    texts = [(i, f.name) for i, f in enumerate(fields) if isinstance(f.dataType, StringType)]
    if order is not None and texts:
        first = first_values(df, [c for _, c in texts], SAMPLE, order)
        dates = first.agg(*[F.coalesce(F.bool_and(F.when(_q(c).isNotNull(), inference.parses_as_date(_q(c)))), F.lit(False)).alias(f"date{i}") for i, c in texts])
        got = got.drop(*[f"date{i}" for i, _ in texts]).join(F.broadcast(dates))  # one row beside one row
    rows = [
        F.struct(F.lit(f.name).alias("column_name"), inference.oracle_type(f.dataType, F.col(f"k{i}"), F.col("n") - F.col(f"k{i}"), F.col(f"max{i}"), F.col(f"len{i}"), F.col(f"date{i}"), F.col(f"bool{i}"), mode).alias("oracle_type"))
        for i, f in enumerate(fields)
    ]
    return got.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(table).alias("table_name"), "r.*")


def boolean_like(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """table_name, column_name, is_boolean_like: all non-null values are truth words."""
    aggs = [F.coalesce(F.bool_and(F.when(_q(c).isNotNull(), F.lower(_q(c).cast("string")).isin(inference.BOOLEAN_TEXTS))), F.lit(False)).alias(f"b{i}") for i, c in enumerate(columns)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").alias("is_boolean_like")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select(F.lit(table).alias("table_name"), "r.*")


def address_shape(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """street, city, state, zip (shares of the first 50 values that show each) and is_address."""
    v = F.col("value")
    share = lambda p: F.avg(v.rlike(p).cast("int"))
    s = samples(df, column, ADDRESS_SAMPLE, order).agg(share(r"\d+\s+[A-Za-z]+").alias("street"), share(r",\s*[A-Z][a-z]+").alias("city"), share(r"\b[A-Z]{2}\b").alias("state"), share(r"\b\d{5}(-\d{4})?\b").alias("zip"))
    named = F.lit(naming.has_any(column, naming.ADDRESS_WORDS))
    hit = (F.col("street") > 0.5) | ((F.col("city") > 0.3) & ((F.col("state") > 0.3) | (F.col("zip") > 0.3)))
    return s.withColumn("is_address", named & F.coalesce(hit, F.lit(False)))


def json_shape(df: DataFrame, column: str, order: list[str], mode: str = "textbook") -> DataFrame:
    """share (of the first 10 values that are JSON; in ``textbook`` mode objects or arrays), is_json (over 70 %)."""
    v = F.col("value")
    ok = F.try_parse_json(v).isNotNull()
    if mode == "textbook":
        ok = ok & v.rlike(r"^\s*[\[\{]")
    s = samples(df, column, JSON_SAMPLE, order).agg(F.avg(ok.cast("int")).alias("share"))
    return s.withColumn("is_json", F.coalesce(F.col("share") > 0.7, F.lit(False)))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """json_key, n: the keys of all objects in a column, with the number of objects that have them."""
    return df.select(F.explode(F.json_object_keys(_q(column).cast("string"))).alias("json_key")).groupBy("json_key").agg(F.count("*").alias("n"))


def full_name_shape(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """mean_blanks (in the first 50 values) and components ('first+last', 'first+middle+last' or '')."""
    v = F.col("value")
    s = samples(df, column, ADDRESS_SAMPLE, order).agg(F.avg(F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit("")))).alias("mean_blanks"))
    named = naming.has_any(column, naming.FULL_NAME_WORDS)
    parts = F.when(~F.col("mean_blanks").between(1, 3) | F.lit(not named), "").when(F.col("mean_blanks") > 1.5, "first+middle+last").otherwise("first+last")
    return s.withColumn("components", F.coalesce(parts, F.lit("")))


def split_full_name(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_first, _middle and _last in place of a full name; words in between are the middle."""
    words = F.split(F.trim(_q(column)), r"\s+")
    n = F.size(words)
    made = {
        f"{column}_first": F.try_element_at(words, F.lit(1)),
        f"{column}_middle": F.when(n > 2, F.array_join(F.slice(words, 2, n - 2), " ")),
        f"{column}_last": F.when(n > 1, F.try_element_at(words, F.lit(-1))),
    }
    return df.withColumns(made).drop(column)


def split_address(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_street, _city, _state and _zip in place of 'street, city, ST 12345'."""
    v = _q(column)
    none = lambda c: F.when(c != "", c)
    made = {
        f"{column}_street": none(F.trim(F.element_at(F.split(v, ","), 1))),
        f"{column}_city": none(F.trim(F.regexp_extract(v, r",\s*([A-Za-z .'-]+?)\s*(,|$)", 1))),
        f"{column}_state": none(F.regexp_extract(v, r"\b([A-Z]{2})\b(?=\s*\d{5}|\s*$)", 1)),
        f"{column}_zip": none(F.regexp_extract(v, r"\b(\d{5}(-\d{4})?)\s*$", 1)),
    }
    return df.withColumns(made).drop(column)


def split_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """df with a column for each key of a JSON object column."""
    return df.withColumns({f"{column}_{k}": F.get_json_object(_q(column).cast("string"), f"$.{k}") for k in keys}).drop(column)


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a numeric column, the mean of the two middle values where their number is even; nulls and NaN
    don't count, and without values it is null.

    Selection by range counts: values are counted in RANGES equal ranges, the range with the middle is counted anew in
    ranges of its own, and so on until the middle values are an end of their range. A pass moves RANGES rows for each
    task at most, whatever the number of different values.
    """
    v = F.when(~F.isnan(_q(column).cast("double")), _q(column).cast("double"))
    rows = df.select(v.alias("v")).where("v IS NOT NULL")
    infinite = F.col("v").isin(float("inf"), float("-inf"))
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("v") == float("-inf"), 1)).alias("low"), F.count(F.when(F.col("v") == float("inf"), 1)).alias("high"), F.min(F.when(~infinite, F.col("v"))).alias("lo"), F.max(F.when(~infinite, F.col("v"))).alias("hi")).first()
    if not total["n"]:
        return None
    rows = rows.where(~infinite)

    def at(rank: int) -> float:
        if rank < total["low"]:
            return float("-inf")
        if rank >= total["n"] - total["high"]:
            return float("inf")
        rank, lo, hi = rank - total["low"], total["lo"], total["hi"]
        while lo < hi:
            share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
            place = F.when(F.col("v") >= hi, RANGES - 1).otherwise(F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).cast("int")
            counts = rows.where(F.col("v").between(lo, hi)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("place").collect()  # RANGES rows
            for r in counts:
                if rank < r["n"]:
                    break
                rank -= r["n"]
            if rank == 0:
                return r["lo"]
            if rank == r["n"] - 1:
                return r["hi"]
            lo, hi = r["lo"], r["hi"]
        return lo

    below, above = at((total["n"] - 1) // 2), at(total["n"] // 2)
    return below if below == above else below / 2 + above / 2 if abs(below) + abs(above) > 1e300 else (below + above) / 2


def default_value(df: DataFrame, column: str) -> DataFrame:
    """column_name, default_value (text): the median of a numeric column, else the most frequent value (the least
    of several); null without values."""
    numeric = inference.is_numeric(df.schema[column].dataType)
    if numeric:
        found = df.sparkSession.createDataFrame([(exact_median(df, column),)], "m double").select(F.col("m").cast("string").alias("default_value"))
    else:
        counts = df.where(_q(column).isNotNull()).groupBy(_q(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
        top = counts.agg(F.max("n").alias("top"))
        found = counts.join(F.broadcast(top), counts.n == top.top).agg(F.min("v").alias("default_value"))
    return found.select(F.lit(column).alias("column_name"), "default_value")


def column_pair(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """unique_1, unique_2, overlap (shared text values), overlap_ratio (of the smaller side), relationship."""
    x, y = (df.where(_q(c).isNotNull()).select(_q(c).cast("string").alias("v")).distinct() for df, c in ((left, a), (right, b)))
    tagged = x.withColumn("side", F.lit(1)).unionByName(y.withColumn("side", F.lit(2))).groupBy("v").agg(F.sum("side").alias("sides"))
    n = tagged.agg(*[F.count(F.when(F.col("sides").isin(*s), 1)).alias(k) for k, s in (("unique_1", (1, 3)), ("unique_2", (2, 3)), ("overlap", (3,)))])
    least = F.least("unique_1", "unique_2")
    relation = F.when(least == 0, "unknown").when(F.col("unique_1") > 5 * F.col("unique_2"), "many-to-one").when(F.col("unique_2") > 5 * F.col("unique_1"), "one-to-many").otherwise("many-to-many")
    return n.select("unique_1", "unique_2", "overlap", F.when(least > 0, F.col("overlap") / least).otherwise(F.lit(0.0)).alias("overlap_ratio"), relation.alias("relationship"))


def summary(profiles: list) -> str:
    """A text with the number of columns of each table and of those with a high cardinality, from profile rows."""
    by_table: dict[str, list] = {}
    for r in profiles:
        by_table.setdefault(r["table_name"], []).append(r)
    lines = [f"{t}: {len(rows)} columns, {rows[0]['total_count']} rows, {sum(r['cardinality'] == 'high' for r in rows)} nearly unique, {sum(r['null_count'] > 0 for r in rows)} with nulls" for t, rows in sorted(by_table.items())]
    return "\n".join([f"{len(by_table)} tables", *lines])
