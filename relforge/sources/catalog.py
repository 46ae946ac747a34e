"""Tables by name, from folders of CSV, JSON or Parquet; results written back in any of them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

#: The order of rows as they were read; samples and surrogate keys follow it, profiles leave it out.
ROW_ORDER = "_row_ord"


class UnsupportedSource(ValueError):
    """A file whose kind or content can't be read as a table."""


def plain(df: DataFrame) -> DataFrame:
    """df with NaN as null and nested columns as JSON text, so that every column compares by value."""
    made = {}
    for f in df.schema:
        if isinstance(f.dataType, DoubleType | FloatType):
            made[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif isinstance(f.dataType, StructType | ArrayType | MapType):
            made[f.name] = F.to_json(f.name)
    return df.withColumns(made) if made else df


def with_row_order(df: DataFrame) -> DataFrame:
    return df if ROW_ORDER in df.columns else df.withColumn(ROW_ORDER, F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file: as UTF-8, or as Latin-1 if it isn't. A column becomes long, double or boolean if all its
    values are, and stays text otherwise; an empty field is null.

    The file is looked at line by line first: whether all lines are UTF-8, and whether a quoted field goes on over a
    line's end. Only in that rare case one task has to read the file whole; otherwise it is split like any text.
    """
    lines = spark.read.text(path)
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    looks = lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)).alias("utf8"), F.coalesce(F.bool_or(odd % 2 == 1), F.lit(False)).alias("multi")).first()
    raw = spark.read.csv(path, encoding="UTF-8" if looks["utf8"] else "ISO-8859-1", header=True, multiLine=looks["multi"], escape='"')
    if not raw.columns:
        raise UnsupportedSource(f"{path} has no columns")
    return infer_kinds(raw)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder of any file system that Spark reads, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any file system that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def infer_kinds(raw: DataFrame) -> DataFrame:
    """Text columns as long, double or boolean where every value of the column allows it (one job)."""
    fits = []
    for c in raw.columns:
        v = F.trim(F.col(f"`{c}`"))
        fits += [
            F.coalesce(F.bool_and(v.rlike(r"^[+-]?[0-9]{1,18}$")), F.lit(False)),
            F.coalesce(F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull() & v.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"))), F.lit(False)),
            F.coalesce(F.bool_and(F.lower(v).isin("true", "false")), F.lit(False)),
        ]
    got = raw.agg(*[f.alias(str(i)) for i, f in enumerate(fits)]).first()
    out = []
    for i, c in enumerate(raw.columns):
        whole, real, truth = got[3 * i : 3 * i + 3]
        kind = "long" if whole else "double" if real else "boolean" if truth else None
        v = F.col(f"`{c}`")
        out.append((F.trim(v).cast(kind) if kind else v).alias(c))
    return raw.select(out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file with an array of records, one record in each line, or one record over several lines."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    df = spark.read.json(path, multiLine=first is not None and first["value"].lstrip().startswith("["))
    if "_corrupt_record" in df.columns:
        df = spark.read.json(path, multiLine=True)
    if not df.columns or "_corrupt_record" in df.columns:
        raise UnsupportedSource(f"{path} holds no records")
    return df


READERS = {".csv": read_csv, ".json": read_json, ".parquet": lambda spark, path: spark.read.parquet(path)}


@dataclass
class Catalog:
    """DataFrames by table name, and the files that were skipped with the reason."""

    tables: dict[str, DataFrame]
    skipped: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, kinds: tuple[str, ...] = (".csv", ".json", ".parquet")) -> Catalog:
        """Every file of the given kinds in a folder; CSV before JSON before Parquet and each by name. Of two
        files with the same stem the later one counts. A file that can't be read is skipped."""
        found = cls({})
        for kind in kinds:
            for name in (n for n in names_in(spark, folder) if n.endswith(kind)):
                try:
                    found.tables[name[: -len(kind)]] = with_row_order(plain(READERS[kind](spark, f"{folder.rstrip('/')}/{name}")))
                except Exception as error:  # noqa: BLE001  whatever is wrong with one file, the others are read
                    found.skipped[name] = f"{type(error).__name__}: {error}"
        return found

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> DataFrame:
        kind = os.path.splitext(path)[1].lower()
        if kind not in READERS:
            raise UnsupportedSource(f"no reader for {kind or path}")
        return READERS[kind](spark, path)

    def columns(self, name: str) -> list[str]:
        return [c for c in self.tables[name].columns if c != ROW_ORDER]


def export(tables: dict[str, DataFrame], folder: str, kinds: tuple[str, ...] = ("csv", "json")) -> None:
    """One dataset per table and kind: <folder>/<table>.<kind>, written in parallel by Spark."""
    for name, df in tables.items():
        out = df.drop(ROW_ORDER)
        for kind in kinds:
            writer = out.write.mode("overwrite")
            getattr(writer.option("header", True) if kind == "csv" else writer, kind)(f"{folder}/{name}.{kind}")
