"""Minimal dependencies, composite references and inclusions against brute force."""

import random
from itertools import combinations

import pytest

from relforge.operators import dependencies as deps
from relforge.operators import foreign_keys as fks
from relforge.operators import lattice
from relforge.operators.lattice import Dependency
from relforge.plans import ddl, erd


def brute_force(data, columns, most=3):
    found = []
    for y in range(len(columns)):
        kept = []
        for size in range(most + 1):
            for x in combinations([c for c in range(len(columns)) if c != y], size):
                groups = {}
                for r in data:
                    groups.setdefault(tuple(r[c] for c in x), set()).add(r[y])
                if all(len(v) == 1 for v in groups.values()) and not any(set(k) <= set(x) for k in kept):
                    kept.append(x)
        found += [Dependency(tuple(columns[c] for c in x), columns[y]) for x in kept]
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_lattice_equals_brute_force(spark, monkeypatch, seed):
    """Also where the sample is too small to refute anything."""
    rng = random.Random(seed)
    monkeypatch.setattr(deps, "REFUTING_ROWS", [100_000, 3, 0, 1][seed])
    data = []
    for i in range(40):
        a, b = rng.randint(0, 5), rng.choice(["x", "y", None])
        data.append((a, b, f"{a}{b}", (a * 3) % 4 if rng.random() < 0.98 else 9, None if seed == 1 else rng.choice([1.5, 2.5, None]), "one"))
    columns = ["a", "b+c", "a+b", "d", "e", "k"]
    df = spark.createDataFrame(data, "a int, `b+c` string, `a+b` string, d int, e double, k string")
    assert lattice.minimal_dependencies(df) == brute_force(data, columns)


def test_lattice_of_few_rows(spark):
    one = spark.createDataFrame([(1, None)], "a int, b string")
    assert lattice.minimal_dependencies(one) == [Dependency((), "a"), Dependency((), "b")] == lattice.minimal_dependencies(one.limit(0))
    assert lattice.minimal_dependencies(spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")) == [Dependency((), "a")]


def test_sample_keeps_close_hashes_apart(spark):
    """Hashes of a column with nulls stay whole: as floats some would be equal."""
    df = spark.range(60_000).selectExpr("IF(id % 7 = 0, NULL, id) AS a", "id AS b")
    sample = deps.Sample(df)
    assert len(set(sample.columns["a"].tolist())) == len([i for i in range(60_000) if i % 7]) + 1


def test_names_with_plus(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 1, 3)], "a int, b int, `a+b` int")
    facts = deps.collect_ratios(df, [("a", "b"), ("a+b",)], ["a", "b", "a+b"])
    assert facts[("a", "b"), "a+b"] == 1 and facts[("a+b",), "a"] == 1
    assert deps.free_of_duplicates(df.dropDuplicates(), [("a", "b"), ("a+b",), ("a",)]) == [("a", "b"), ("a+b",)]


def composite_tables(spark):
    lines = spark.createDataFrame([(o, n, o * n) for o in range(20) for n in range(3)], "order_id int, line_no int, qty int")
    returns = spark.createDataFrame([(i, i % 20, i % 3, (i + 1) % 3, "x") for i in range(30)] + [(30, None, 2, 1, "y")], "return_id int, order_ref bigint, line_no int, other_no int, why string")
    return {"lines": lines, "returns": returns}


def test_composite_references(spark):
    tables = composite_tables(spark)
    facts = deps.measure_all(tables)
    facts["lines"].primary_key, facts["returns"].primary_key = ("order_id", "line_no"), ("return_id",)
    (found,) = fks.composite(tables, facts)
    assert (found.fk_table, found.columns, found.pk_table, found.targets) == ("returns", ("order_ref", "line_no"), "lines", ("order_id", "line_no"))
    made = ddl.foreign_key_constraints([found], {"lines": ("order_id", "line_no")}, facts)
    assert "FOREIGN KEY (order_ref, line_no)\n    REFERENCES lines(order_id, line_no);" in made.statements[0] and ddl.indexes(made.kept) == ["CREATE INDEX idx_returns_1 ON returns(order_ref, line_no);"]
    assert ddl.foreign_key_constraints([found], {"lines": ("order_id",)}, facts).skipped == ["returns.order_ref, line_no: lines.order_id, line_no is not unique on its own"]
    assert erd.edges([found]) == [("returns", "lines", "order_ref, line_no → order_id, line_no")]
    few = tables | {"lines": tables["lines"].where("order_id <> 4 OR line_no <> 1")}
    assert fks.composite(few, facts) == []
    assert fks.composite(tables, facts, [fks.ForeignKey("lines", "order_id", "returns", "return_id")]) == []


def test_columns_alone_are_not_enough(spark):
    """Every column is included, the pairs are not."""
    parent = spark.createDataFrame([(1, 1), (2, 2)], "a_id int, b_id int")
    child = spark.createDataFrame([(1, 1, 2)], "c_id int, a_id int, b_id int")
    facts = deps.measure_all({"p": parent, "c": child})
    facts["p"].primary_key, facts["c"].primary_key = ("a_id", "b_id"), ("c_id",)
    assert fks.composite({"p": parent, "c": child}, facts) == []


@pytest.mark.parametrize("one_in", [1, 2, 64])
def test_refutation_is_exact(spark, one_in):
    """What is refuted is no inclusion, and enough missing values are always seen."""
    tables = {"p": spark.range(500).selectExpr("id AS k", "id % 7 AS m"), "c": spark.range(500).selectExpr("IF(id = 3, NULL, id) AS inside", "id + 1 AS one_out", "id + 9000 AS outside", "CAST(NULL AS long) AS none")}
    pairs = [(("c", (c,)), ("p", ("k",))) for c in ("inside", "one_out", "outside", "none")]
    out = fks.refuted(tables, pairs, one_in)
    assert 2 in out and not out & {0, 3} and (one_in > 1 or 1 in out)
    assert fks._counted(tables, pairs)[0] == (499, 0) and fks._counted(tables, pairs)[3] == (0, 0) and fks._counted(tables, pairs)[1][1] == 1


def test_tuples_do_not_mix(spark):
    """A null, or text that joins alike, is no match."""
    tables = {"p": spark.createDataFrame([("a", "bc"), ("x", None)], "k string, l string"), "c": spark.createDataFrame([("ab", "c"), (None, "x")], "k string, l string")}
    assert fks._counted(tables, [(("c", ("k", "l")), ("p", ("k", "l")))]) == [(1, 1)]
