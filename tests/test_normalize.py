from relforge.operators import dependencies as deps
from relforge.operators import normalize as norm
from relforge.operators import validate
from relforge.operators.foreign_keys import ForeignKey


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_explode_keeps_order_free_parts(spark):
    df = spark.createDataFrame([(1, "a, b,,a"), (2, " plain "), (3, None), (4, "p/q/r/s4/4")], "k int, v string")
    assert norm.pick_delimiter(df, "v", ["k"]) == ","
    assert rows(norm.explode_values(df.where("k < 4"), "v", ["k"], ",")) == [(1, "a"), (1, "a"), (1, "b"), (2, " plain ")]
    assert rows(norm.explode_values(df.where("k = 4"), "v", ["k"], "/")) == [(4, "4"), (4, "p"), (4, "q"), (4, "r"), (4, "s4")]


def test_second_form_is_lossless(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (None, 1, None)], "order_id int, line int, name string")
    pieces = norm.second_normal_form("t", df, {("order_id",): ["name"]})
    assert tuple(validate.rejoin_difference(df, [(pieces["t"], []), (pieces["t_order_id"], ["order_id"])]).first()) == (0, 0)
    broken = pieces["t_order_id"].where("order_id = 1")
    assert tuple(validate.rejoin_difference(df, [(pieces["t"], []), (broken, ["order_id"])]).first()) == (1, 1)


def test_surrogate_numbers_rows_in_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)], "k int, v string")
    got = rows(norm.surrogate_key(df, "id", ["k"]).select("id", "k"))
    assert got == [(i + 1, i) for i in range(101)]


def test_surrogate_is_whole_on_many_rows(spark):
    from pyspark.sql import functions as F

    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 % 250_000).alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("wide"))
    keyed = norm.surrogate_key(df, "id", ["k"])
    parts = [keyed.select("id", "wide"), keyed.where("k % 2 = 0").select("id", "wide").unionByName(keyed.where("k % 2 = 1").select("id", "wide"))]
    for got in parts:  # every use of the result has the same keys
        assert tuple(got.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()) == (1_000_000, 1_000_000, 1, 1_000_000)
    assert parts[0].join(parts[1], ["id", "wide"]).count() == 1_000_000
    assert norm.surrogate_key(df.limit(0), "id", ["k"]).count() == 0


def test_numbers_within_groups(spark):
    from pyspark.sql import functions as F

    from relforge.sources.scratch import numbered

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("g"), (F.col("id") % 100).alias("o"), "id")
    got = numbered(df, [F.col("o"), F.col("id")], "n", ["g"], start=0).toPandas()
    want = df.toPandas().sort_values(["o", "id"]).assign(n=lambda x: x.groupby("g", dropna=False).cumcount())
    assert sorted(zip(got.id, got.n, strict=True)) == sorted(zip(want.id, want.n, strict=True))


def test_key_choice(spark):
    df = spark.createDataFrame([(i, f"c{i}", f"m{i}@x.org") for i in range(20)], "item_ref int, product_code string, email string")
    facts = deps.measure(df, "t")
    assert norm.choose_key("t", facts, []).columns == ("product_code",)
    none = deps.measure(df.select("email"), "t")
    assert norm.choose_key("t", none, []) == norm.KeyChoice(("t_id",), True)
    assert norm.repeating_foreign_key("t", "customer_id", deps.TableFacts("t", ["customer_id"], 5, {"customer_id": 2}, {"customer_id": 5}), [])


def test_entity_score_and_pattern(spark):
    assert norm.entity_score(20, 100, "supplier_id", ["supplier_name", "supplier_email"]).is_entity
    assert not norm.entity_score(3, 100, "status", ["label"]).is_entity
    df = spark.createDataFrame([(1, "open"), (1, "shut"), (2, "open")], "ticket_id int, status string")
    assert norm.multi_row_pattern(df, "tickets", "ticket_id", deps.measure(df, "tickets")).kind == "status_history"
    assert norm.multi_row_pattern(df.limit(1), "tickets", "ticket_id", deps.measure(df.limit(1), "tickets")) is None


def test_move_to_parent(spark):
    parent = spark.createDataFrame([(1,), (2,)], "customer_id int")
    child = spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], "order_id int, customer_id int, segment string")
    out = norm.move_to_parent({"customers": parent, "orders": child}, {"customers": ("customer_id",), "orders": ("order_id",)}, [ForeignKey("orders", "customer_id", "customers", "customer_id")])
    assert rows(out["customers"].fillna("-")) == [(1, "a"), (2, "-")] and out["orders"].columns == ["order_id", "customer_id"]


def test_placement(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id int, g string, v string")
    assert norm.placement(df, ("id",), "v", ["id", "g", "v"]) == "key"
    assert norm.placement(df.select("g", "v"), ("v",), "g", ["g", "v"]) == "key"


def test_lists_become_child_tables(spark):
    data = [(1, '["a, b", "c[d]", null]', [1, 2], '[{"k": "x", "n": 1}, {"k": "y,z"}]', "p;q"), (2, "[]", None, None, "p;q"), (3, None, [], '[{"n": [3, 4]}]', "p;q"), (4, '["a, b"]', [7], "[]", "p;q")]
    df = spark.createDataFrame(data, "id int, texts string, numbers array<int>, objects string, plain string")
    found = norm.first_normal_form("t", df, ["id"], ["texts", "numbers", "objects", "plain"], ["id"])
    assert found["t"].columns == ["id"]
    assert sorted(map(tuple, found["t_texts"].collect()), key=repr) == [(1, 0, "a, b"), (1, 1, "c[d]"), (1, 2, None), (4, 0, "a, b")]
    assert rows(found["t_numbers"]) == [(1, 0, "1"), (1, 1, "2"), (4, 0, "7")]
    objects = found["t_objects"]
    assert objects.columns == ["id", "objects_position", "objects_k", "objects_n"]
    assert sorted(map(tuple, objects.collect()), key=repr) == [(1, 0, "x", "1"), (1, 1, "y,z", None), (3, 0, None, "[3,4]")]
    assert found["t_plain"].count() == 8
    mixed = spark.createDataFrame([(1, "[1]"), (2, "no list"), (3, '["x"]'), (4, "[1, "), (5, "[2]"), (6, "[3]"), (7, None)], "id int, v string")
    assert rows(norm.first_normal_form("t", mixed, ["id"], ["v"], ["id"])["t_v"]) == [(1, 0, "1"), (2, 0, "no list"), (3, 0, "x"), (4, 0, "[1, "), (5, 0, "2"), (6, 0, "3")]


def test_children_of_lists_have_keys(spark):
    df = spark.createDataFrame([(i, f'["a{i}, x", "b"]') for i in range(12)], "order_id int, tags string")
    found = norm.normalize({"orders": df}, {"orders": deps.profile_table(df, "orders", full_matrix=False)}, [])
    assert found.keys["orders_tags"] == ("order_id", "tags_position") and not found.warnings
    assert [(k.fk_table, k.columns, k.pk_table) for k in found.foreign_keys] == [("orders_tags", ("order_id",), "orders")]
    assert validate.validate(found.tables, found.keys, found.foreign_keys).is_valid


def test_object_keys_come_from_the_first_lists(spark, monkeypatch):
    """Lists beyond the first rows are taken apart only if those hold too few values."""
    asked = []
    real = norm.explode_list
    monkeypatch.setattr(norm, "HEAD_ROWS", 60)
    monkeypatch.setattr(norm, "explode_list", lambda df, c, key: (asked.append(df.count()), real(df, c, key))[1])
    full = [(i, '[{"a": 1}, {"b": 2}]' if i < 100 else '["text"]') for i in range(200)]
    late = [(i, "[]" if i < 80 else '[{"c": 1}]' if i % 2 else "[null]") for i in range(200)]
    for data, rows, keys in ((full, [60, 200], ["a", "b"]), (late, [60, 200, 200], ["c"])):
        df = spark.createDataFrame(data, "k int, v string")
        made = norm.first_normal_form("t", df, ["k"], ["v"], ["k"])
        assert [c for c in made["t_v"].columns] == ["k", "v_position", *[f"v_{x}" for x in keys]]
        assert sorted(asked) == rows
        asked.clear()
