import os
import subprocess
import sys
import tempfile

from relforge.functions import inference
from relforge.operators import profile
from relforge.sources.catalog import Catalog, UnsupportedSource, export

import pytest
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.0, None), (3, 1.0, "a")], "k int, v double, s string")
    got = {r["column_name"]: r for r in profile.column_profile(df, "t").collect()}
    assert (got["v"]["null_count"], got["v"]["unique_count"]) == (1, 1)
    assert got["k"]["cardinality"] == "high" and got["s"]["null_count"] == 1
    empty = profile.column_profile(df.limit(0), "t").collect()
    assert all(r["uniqueness_ratio"] == 0 and r["total_count"] == 0 for r in empty)


def test_types(spark):
    df = spark.createDataFrame([(1, 2**40, True, "2024-01-31", "yes", "abc", None)], "a int, b long, c boolean, d string, e string, f string, g string")
    got = {r["column_name"]: r["oracle_type"] for r in profile.oracle_types(df, "t").collect()}
    assert got == {"a": "NUMBER(10)", "b": "NUMBER(19)", "c": "CHAR(1)", "d": "DATE", "e": "CHAR(1)", "f": "VARCHAR2(4)", "g": "VARCHAR2(4000)"}
    assert {r["column_name"]: r["oracle_type"] for r in profile.oracle_types(df, "t", mode="compat").collect()}["c"] == "NUMBER(15,2)"


def test_date_parsing(spark):
    values = ["2024-01-31", "11:30", "1/31/2024", "2024-02-31", "555-7302", "CS183", "10001", "25:10"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = dict(rows(df.select("v", inference.parses_as_date(F.col("v")))))
    assert [v for v in values if got[v]] == ["2024-01-31", "11:30", "1/31/2024"]


def test_multivalued(spark):
    df = spark.createDataFrame([(i, "a,b", "11:30", "x") for i in range(5)], "k int, tags string, at string, one string")
    got = {r["column_name"]: r["is_multivalued"] for r in profile.multivalued(df, "t", ["tags", "at", "one"], ["k"]).collect()}
    assert got == {"tags": True, "at": False, "one": False}
    compat = {r["column_name"]: r["is_multivalued"] for r in profile.multivalued(df, "t", ["at"], ["k"], mode="compat").collect()}
    assert compat["at"]


def test_splitters(spark):
    df = spark.createDataFrame([("Ann Mary Lee", "1 Main St, Salem, OR 97301", '{"k": 5}')], "name string, address string, props string")
    assert rows(profile.split_full_name(df.select("name"), "name")) == [("Ann", "Mary", "Lee")]
    assert rows(profile.split_address(df.select("address"), "address")) == [("1 Main St", "Salem", "OR", "97301")]
    assert rows(profile.split_json(df.select("props"), "props", ["k"])) == [("5",)]


def test_defaults_and_pairs(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (None, None)], "n int, s string")
    assert rows(profile.default_value(df, "n")) == [("n", "2.5")]
    assert rows(profile.default_value(df, "s")) == [("s", "a")]
    assert rows(profile.column_pair(df, "n", df.limit(0), "s"))[0][-1] == "unknown"


def test_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name,flag,empty\n1,Zo\xeb,true,\n2,\"x,y\",false,\n".encode("latin-1"))
    (tmp_path / "b.json").write_text('[{"id": 1, "v": 1.5}, {"id": 2, "v": null}]')
    (tmp_path / "c.csv").write_text("")
    found = Catalog.from_folder(spark, str(tmp_path))
    assert sorted(found.tables) == ["a", "b"] and list(found.skipped) == ["c.csv"]
    assert dict(found.tables["a"].drop("_row_ord").dtypes) == {"id": "bigint", "name": "string", "flag": "boolean", "empty": "string"}
    assert [r["name"] for r in found.tables["a"].orderBy("id").collect()] == ["Zoë", "x,y"]
    with pytest.raises(UnsupportedSource):
        Catalog.from_file(spark, "x.xml")
    export(found.tables, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "b.json")).count() == 2


def test_distinct_values_of_any_number_go_to_tasks_of_a_bounded_number(spark, monkeypatch):
    monkeypatch.setattr(profile, "FEW_VALUES", 500, raising=False)
    monkeypatch.setattr(profile, "VALUES_IN_A_TASK", 2_000, raising=False)
    monkeypatch.setattr(profile, "HELD_ROWS", 4_000, raising=False)
    n = 40_000
    i = F.col("id")
    hot = F.when(i % 3 == 0, 7).when(i % 5 > 0, i)  # a third of the rows have one value, others none
    df = spark.range(0, n, 1, 3).select(i.alias("k"), hot.alias("h"), F.concat(F.lit("x"), i % 20_000).alias("s"), F.timestamp_micros(i).alias("t"), F.when(i % 2 == 0, float("nan")).otherwise(i / 4).alias("d"), (i % 4).alias("few"))
    got = {r["column_name"]: (r["n"], r["k"], r["u"]) for r in profile.column_counts(df, "t").collect()}
    held = [7 if x % 3 == 0 else x for x in range(n) if x % 3 == 0 or x % 5 > 0]
    assert got == {"k": (n, n, n), "h": (n, len(held), len(set(held))), "s": (n, n, 20_000), "t": (n, n, n), "d": (n, n // 2, n // 2), "few": (n, n, 4)}
    groups = profile._value_groups(df, "t", profile.first_look({"t": df})["t"])
    sizes = groups.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 2 * profile.VALUES_IN_A_TASK


def test_what_goes_to_the_tasks_needs_no_package_there():
    from pyspark import cloudpickle

    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); import pyarrow as pa; b = pa.record_batch({'a': [1, 1, 2]}); print(sum(x.num_rows for x in f([b, b])), 'relforge' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(profile._fewer(10)), capture_output=True, cwd=tempfile.gettempdir(), env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == [b"2", b"False"], done.stderr
