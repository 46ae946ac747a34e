"""Column expressions that infer types and shapes of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

#: Texts that count as truth values, characters that separate values in one field.
BOOLEAN_TEXTS = ["true", "false", "0", "1", "t", "f", "yes", "no", "y", "n"]
DELIMITERS = [",", ";", "|", "/", ":", "\n", "\t"]
SPLIT_DELIMITERS = [",", ";", "|", "/", ":"]
#: Date patterns that the parse test knows, as (regular expression, format).
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2})?$", None), (r"^\d{1,2}:\d{2}(:\d{2})?$", None),
]


def parses_as_date(v: Column) -> Column:
    """Whether a text is a date, a date with a time, or a clock time, in one of the known formats."""
    tests = []
    for pattern, fmt in DATE_FORMATS:
        ok = v.rlike(pattern)
        if fmt:
            ok = ok & F.try_to_timestamp(v, F.lit(fmt)).isNotNull()
        elif pattern.startswith(r"^\d{4}"):
            ok = ok & v.try_cast("timestamp").isNotNull()
        else:
            ok = ok & (F.regexp_extract(v, r"^(\d+)", 1).try_cast("int") < 24) & (F.regexp_extract(v, r":(\d\d)", 1).try_cast("int") < 60)
        tests.append(F.coalesce(ok, F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, IntegralType | DoubleType | FloatType | DecimalType)


def oracle_type(kind: DataType, non_null: Column, null_count: Column, largest: Column, longest: Column, dates: Column, booleans: Column, mode: str) -> Column:
    """The DDL type of a column from its aggregates."""
    empty = non_null == 0
    size = F.least(F.floor(longest * 1.5), F.lit(4000)).cast("int")
    text = F.when(longest < 1, F.lit("VARCHAR2(255)")).otherwise(F.concat(F.lit("VARCHAR2("), size.cast("string"), F.lit(")")))
    if isinstance(kind, BooleanType):
        found = F.lit("NUMBER(15,2)" if mode == "compat" else "CHAR(1)")
    elif isinstance(kind, IntegralType):
        found = F.when(largest <= 2147483647, F.lit("NUMBER(10)")).otherwise(F.lit("NUMBER(19)"))
        if mode == "compat":
            found = F.when(null_count > 0, F.lit("NUMBER(15,2)")).otherwise(found)
    elif is_numeric(kind):
        found = F.lit("NUMBER(15,2)")
    elif isinstance(kind, TimestampType | TimestampNTZType):
        found = F.lit("TIMESTAMP")
    elif isinstance(kind, DateType):
        found = F.lit("DATE")
    elif isinstance(kind, StringType):
        found = F.when(dates, F.lit("DATE")).when(booleans, F.lit("CHAR(1)")).otherwise(text)
    else:
        found = text
    return F.when(empty, F.lit("VARCHAR2(4000)")).otherwise(found)


def cardinality(unique: Column, total: Column) -> Column:
    ratio = F.when(total > 0, unique / total).otherwise(F.lit(0.0))
    return F.when(ratio > 0.95, "high").when(ratio > 0.5, "medium").when(unique < 50, "low").otherwise("medium")


def null_strategy(ratio: Column) -> Column:
    return (
        F.when(ratio < 0.01, "NOT NULL")
        .when(ratio < 0.1, "NULLABLE - Consider default value")
        .when(ratio < 0.5, "NULLABLE - Common")
        .otherwise("NULLABLE - High null ratio, consider redesign")
    )
