import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from relforge.operators import dependencies as deps


def brute_ratio(pdf, x, y):
    groups = pdf.groupby(list(x), dropna=False)[y].nunique()
    return float((groups == 1).mean()) if len(groups) else 1.0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.sampled_from([None, "x", "y"]), st.sampled_from(["p", "q"])), min_size=1, max_size=12))
def test_ratio_equals_brute_force(spark, data):
    pdf = pd.DataFrame(data, columns=["a", "b", "c"])
    df = spark.createDataFrame(data, "a string, b string, c string")
    got = deps.collect_ratios(df, [("a",), ("a", "b")])
    for (x, y), r in got.items():
        assert abs(r - brute_ratio(pdf, x, y)) < 1e-9


def test_null_determinants_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "a string, b int")
    assert deps.collect_ratios(df, [("a",)])[(("a",), "b")] == 0.5
    assert deps.collect_ratios(df, [("a",)], None, True)[(("a",), "b")] == 1.0
    assert deps.collect_ratios(df.limit(0), [("a",)])[(("a",), "b")] == 1.0


def test_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (3, 1, "a")], "order_id int, line_id int, name string")
    facts = deps.profile_table(df, "lines")
    assert facts.candidate_keys == [("order_id", "line_id")] and facts.primary_key == ("order_id", "line_id")
    assert facts.partial == {("order_id",): ["name"]} and facts.violates_2nf
    assert facts.dependencies["order_id"] == ["name"]


def test_single_key_needs_no_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "row_id int, v string")
    facts = deps.measure(df, "t")
    assert deps.candidate_keys(df, facts) == [("row_id", "v")]


def test_transitive(spark):
    data = [(i, f"s{i % 12}", f"Supplier {i % 12}", f"City {i % 12}") for i in range(60)]
    df = spark.createDataFrame(data, "product_id int, supplier_id string, supplier_name string, supplier_city string")
    found = deps.profile_table(df, "products").transitive
    assert (("product_id",), "supplier_id", ["supplier_name", "supplier_city"]) in found
    assert deps.profile_table(df, "products", "compat").transitive == []


def test_genuine_entity():
    assert deps.genuine_entity("supplier_id", ["supplier_name", "city_name"], 20, 100)
    assert not deps.genuine_entity("supplier_id", ["supplier_name"], 20, 100)
    assert not deps.genuine_entity("status_id", ["a", "b"], 20, 100)
    assert not deps.genuine_entity("supplier_id", ["a", "b"], 5, 100)


def test_refuting_sample_drops_nothing_that_holds(spark, monkeypatch):
    from itertools import combinations

    rows = [(i, i // 3, i % 4 if i % 5 else None, str(i // 6), None) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g int, m int, t string, empty string")
    sets = [(c,) for c in df.columns] + list(combinations(["g", "m", "t"], 2))
    for least, facts in ((1, None), (0.99, deps.measure(df, "t"))):
        for drop in (False, True):
            whole = deps.collect_ratios(df, sets, drop_null_determinants=drop)
            some = deps.collect_ratios(df, sets, drop_null_determinants=drop, at_least=least, facts=facts)
            assert {k: v for k, v in some.items() if v >= least} == {k: v for k, v in whole.items() if v >= least}
    monkeypatch.setattr(deps, "REFUTING_ROWS", 10)
    assert deps.collect_ratios(df, sets, drop_null_determinants=True, at_least=1).keys() >= {k for k, v in whole.items() if v == 1}
    stats = {c: (deps.measure(df, "t").unique[c], deps.measure(df, "t").non_null[c]) for c in df.columns}
    assert deps.unique_sets(df, df.columns, stats, 120, 2)[:1] == [("id",)]


def test_every_key_of_the_least_size(spark):
    rows = [(i, i // 2, i % 2, i // 2 + 100, i % 2 + 7) for i in range(20)]
    df = spark.createDataFrame([r[1:] for r in rows], "a_ref int, b_ref int, c_ref int, d_ref int")
    assert deps.candidate_keys(df, deps.measure(df, "t")) == [("a_ref", "b_ref"), ("a_ref", "d_ref"), ("b_ref", "c_ref"), ("c_ref", "d_ref")]


def test_sets_are_asked_of_all_combinations(spark):
    """One combination that occurs twice is found whether its hash is looked at first or not; nulls are equal."""
    base = [(i, i % 7, f"t{i}") for i in range(60)]
    for again in range(0, 60, 6):
        df = spark.createDataFrame([*base, base[again][:2] + ("other",)], "a int, b int, c string")
        assert deps.free_of_duplicates(df, [("a",), ("a", "b"), ("c",), ("a", "c")]) == [("c",), ("a", "c")]
    df = spark.createDataFrame([(None, 1, None), (None, 2, "x"), (3, 1, None)], "a int, b int, c string")
    assert deps.free_of_duplicates(df, [("a",), ("c",), ("a", "b"), ("a", "c")]) == [("a", "b"), ("a", "c")]
    assert deps.free_of_duplicates(df, []) == [] and deps.free_of_duplicates(df.limit(0), [("a",)]) == [("a",)]


def test_equal_hashes_are_compared_by_value(spark, monkeypatch):
    """Hashes that meet by chance make no duplicate, and what is stored has one column for each of the sets' columns."""
    stored = []
    real = deps.saved
    monkeypatch.setattr(deps, "saved", lambda df, tag: (stored.append(df.columns), real(df, tag))[1])
    whole = deps.row_hash
    monkeypatch.setattr(deps, "row_hash", lambda columns, seed=0: whole(columns, seed) % 5)
    df = spark.createDataFrame([(i, i % 7, f"t{i // 2}") for i in range(60)], "a int, b int, c string")
    assert deps.free_of_duplicates(df, [("a",), ("b",), ("c",), ("b", "c"), ("a", "c")], {"a": 60, "b": 7, "c": 30}) == [("a",), ("b", "c"), ("a", "c")]
    assert [sorted(x) for x in stored] == [["a", "b", "c"]]
