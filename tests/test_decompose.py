"""Lossless splits, keys and references by construction, key translation."""

import random

import pytest

from relforge.operators import decompose, normalize, validate
from relforge.operators import dependencies as deps
from relforge.operators.decompose import Piece
from relforge.operators.foreign_keys import ForeignKey
from relforge.plans import workflow
from relforge.sources.catalog import ROW_ORDER, with_row_order


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(spark, n=200, odd=((0, 2, "other"), (5, 1, None))):
    """a_id -> name holds but for a few rows of a few keys."""
    data = []
    for a in range(n):
        for line in range(3):
            name = next((v for x, k, v in odd if (x, k) == (a, line)), f"name {a}")
            data.append((a, line, name, a % 7, f"{a}-{line}"))
    return spark.createDataFrame(data, "a_id int, line_no int, name string, grade int, note string")


def test_split_keeps_deviating_rows(spark):
    df = planted(spark)
    facts = deps.profile_table(df, "t", full_matrix=False)
    assert facts.primary_key == ("a_id", "line_no") and facts.partial == {("a_id",): ["name", "grade"]}
    found = normalize.decompose("t", with_row_order(df), facts, set())
    names = {p.name: p for p in found.pieces}
    assert rows(names["t_a_id_exceptions"].df) == [(0, 2, "other", 0), (5, 1, None, 5)]
    assert names["t_a_id"].key == ("a_id",) and names["t_a_id"].df.count() == 200 and names["t_a_id"].reference == ForeignKey("t", "a_id", "t_a_id", "a_id", reason="split")
    assert tuple(validate.difference(df, decompose.rebuilt(found)).first()) == (0, 0)
    plain = normalize.second_normal_form("t", df, facts.partial)  # the same without exceptions makes up rows
    assert tuple(validate.rejoin_difference(df, [(plain["t"], []), (plain["t_a_id"], ["a_id"])]).first()) == (0, 6)


def test_violation_table(spark):
    df = planted(spark)
    assert rows(decompose.violations(df, ("a_id",), "name")) == [(0, 3, 2, 1), (5, 3, 2, 1)]
    assert rows(decompose.violations(df, ("a_id",), "grade")) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_table_comes_back(spark, seed):
    """Nulls in determinants and attributes, ties, repeated rows: nothing is lost or made up."""
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None]), rng.choice([1.5, None, float("nan")])) for i in range(60)]
    df = spark.createDataFrame(data, "id int, a int, b string, c double")
    rest, made = decompose.split(Piece("t", df, "t", "rest", (), tuple(df.columns), ("id",)), "t_a", ("a",), ["b", "c"], "entity", ("id",))
    assert [p.kind for p in made] == ["entity", "exceptions"] and made[0].df.where("a IS NULL").isEmpty()
    back = decompose.rebuilt(decompose.Decomposition("t", rest, made))
    assert tuple(validate.difference(df, back).first()) == (0, 0)
    counts = {}
    for _, a, b, c in data:
        if a is not None:
            counts.setdefault(a, {}).setdefault((b, "nan" if c is not None and c != c else c), []).append(1)
    most = {a: max(map(len, x.values())) for a, x in counts.items()}
    assert made[1].df.count() == 60 - sum(most.values()) - sum(1 for _, a, b, c in data if a is None and b is None and c is None)


def test_no_key_no_split_of_deviating_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "a int, b string")
    piece = Piece("t", df, "t", "rest", (), ("a", "b"), ())
    assert decompose.split(piece, "t_a", ("a",), ["b"], "entity", ()) == (piece, [])
    rest, made = decompose.split(Piece("t", df.where("b <> 'b'"), "t", "rest"), "t_a", ("a",), ["b"], "entity", ())
    assert rest.df.columns == ["a"] and [p.kind for p in made] == ["entity"]


def test_hot_keys_are_spread(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 5 > 0, F.col("id")).alias("k"))
    facts = df.where("k IS NOT NULL").select(F.col("k").alias("id")).distinct().withColumn("v", F.concat(F.lit("v"), "id"))
    got = decompose.spread_join(df, facts, [("k", "id")], ["v"])
    assert got.columns == ["id", "k", "v"] and got.count() == 20_000 and got.select("id").distinct().count() == 20_000
    assert got.where("NOT (v <=> concat('v', k))").isEmpty()
    empty = decompose.spread_join(df.limit(0), facts.limit(0), [("k", "id")], ["v"])
    assert empty.count() == 0


def chain(spark):
    """Lines of orders of suppliers: a part of the key, then an entity of that part."""
    data = [(o, n, o % 40, f"s{o % 40}", f"s{o % 40}@x.org", o % 40 * 3) for o in range(400) for n in range(2)]
    return spark.createDataFrame(data, "order_id int, line_no int, supplier_code int, supplier_name string, supplier_email string, supplier_rank int")


def test_references_between_pieces(spark):
    df = chain(spark)
    facts = {"lines": deps.profile_table(df, "lines", full_matrix=False)}
    found = normalize.normalize({"lines": df}, facts, [])
    links = {(k.fk_table, k.columns, k.pk_table, k.targets) for k in found.foreign_keys}
    assert ("lines", ("order_id",), "lines_order_id", ("order_id",)) in links
    assert ("lines_order_id", ("supplier_code",), "supplier", ("supplier_code",)) in links
    assert found.keys["supplier"] == ("supplier_code",) and found.keys["lines_order_id"] == ("order_id",) and found.keys["lines"] == ("order_id", "line_no")
    assert all(tuple(r)[-2:] == (1.0, 0) for r in decompose.coverage(found.tables, found.foreign_keys).collect())
    assert tuple(validate.difference(df, decompose.rebuilt(found.decompositions[0])).first()) == (0, 0)
    assert validate.validate(found.tables, found.keys, found.foreign_keys).is_valid


def test_surrogates_reach_the_children(spark):
    """A determinant that is no identifier gets a surrogate; the table that refers to it has the surrogate instead."""
    data = [(i, f"Vendor {i % 30}", f"v{i % 30}@x.org", f"{i % 30} Road") for i in range(300)]
    df = spark.createDataFrame(data, "purchase_id int, vendor string, vendor_email string, vendor_address string")
    found = normalize.normalize({"purchases": df}, {"purchases": deps.profile_table(df, "purchases", full_matrix=False)}, [])
    link = next(k for k in found.foreign_keys if k.reason == "surrogate")
    assert found.keys["vendor"] == ("vendor_id",) and (link.fk_table, link.columns, link.pk_table) == ("purchases", ("vendor_id",), "vendor")
    assert "vendor" not in found.tables["purchases"].columns
    back = found.tables["purchases"].join(found.tables["vendor"], "vendor_id", "left").select(df.columns)
    assert tuple(validate.difference(df, back).first()) == (0, 0)
    assert tuple(decompose.coverage(found.tables, [link]).first())[3:] == (30, 0, 1.0, 0)


def test_translation_of_nulls_and_strangers(spark):
    parent = spark.createDataFrame([("a", 1), ("b", 2)], "name string, name_id int")
    child = spark.createDataFrame([(1, "a"), (2, None), (3, "gone"), (4, "b")], "id int, who string")
    old = ForeignKey("c", "who", "p", "name")
    frame, link = decompose.translate(Piece("p", parent.drop("name_id"), "c", "entity", ("name",)), parent, "name_id", [("c", child, old)])["c"]
    assert rows(frame) == [(1, 1), (2, None), (3, None), (4, 2)] and link == ForeignKey("c", "name_id", "p", "name_id", reason="surrogate")


def test_moves_to_a_parent_lose_nothing(spark):
    parent = spark.createDataFrame([(1,), (2,)], "customer_id int")
    keys, known = {"customers": ("customer_id",), "orders": ("order_id",)}, [ForeignKey("orders", "customer_id", "customers", "customer_id")]
    for data in ([(1, 1, "a"), (2, 1, None)], [(1, 1, "a"), (2, None, "b")]):
        child = spark.createDataFrame(data, "order_id int, customer_id int, segment string")
        out = normalize.move_to_parent({"customers": parent, "orders": child}, keys, known)
        assert out["orders"].columns == child.columns and out["customers"].count() == 2


def test_mined_composite_keys_stay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "orders.csv").write_text("order_id,placed\n" + "".join(f"{i},x{i % 3}\n" for i in range(40)))
    (folder / "order_items.csv").write_text("order_id,line_no,qty\n" + "".join(f"{i},{k},{(i * 7 + k) % 5}\n" for i in range(40) for k in range(2)))
    state = workflow.run(spark, str(folder))
    assert state.status == "completed", state.errors
    assert state.normalized.keys["order_items"] == ("order_id", "line_no") and state.report.is_valid, state.report.errors
    assert "PRIMARY KEY (order_id, line_no)" in state.script and "REFERENCES orders(order_id)" in state.script


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "a int, b string")
    assert validate.same_rows(df, df.orderBy("b")) and validate.same_rows(df.limit(0), df.limit(0))
    for other in (df.distinct(), df.union(df.limit(1)), spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "2")], df.schema)):
        assert not validate.same_rows(df, other)
    lost, added = validate.difference(df, df.distinct().union(spark.createDataFrame([(9, "z"), (9, "z")], df.schema))).first()
    assert (lost, added) == (1, 2)
    assert ROW_ORDER not in with_row_order(df).drop(ROW_ORDER).columns


def test_pieces_are_stored_once(spark, monkeypatch):
    """What a split makes is read from a table, not worked out again by whatever asks for it; exceptions are the same whether
    the odd determinants are few or many."""
    data = [(k, n, "odd" if k == 3 and n == 0 else f"v{k}") for k in range(30) for n in range(3)] + [(None, 0, "x"), (None, 1, None)]
    df = spark.createDataFrame(data, "k int, n int, v string")
    for few in (200_000, 0):
        monkeypatch.setattr(decompose, "FEW_ODD", few)
        _, made = decompose.split(Piece("t", df, "t", "rest", (), ("k", "n", "v"), ("k", "n")), "t_k", ("k",), ["v"], "part", ("k", "n"))
        assert [p.kind for p in made] == ["part", "exceptions"] and made[0].df.count() == 30
        assert sorted(map(tuple, made[1].df.collect()), key=str) == [(3, 0, "odd"), (None, 0, "x")]
        for p in made:
            plan = p.df._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "Join" not in plan
