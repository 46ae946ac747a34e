from relforge.operators import dependencies as deps
from relforge.operators import foreign_keys as fks


def facts(tables):
    return {t: deps.profile_table(df, t, full_matrix=False) for t, df in tables.items()}


def test_detection_rules(spark):
    customers = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "customer_id int, label string")
    orders = spark.createDataFrame([(i, i % 5, None if i == 3 else i % 5) for i in range(10)], "order_id int, customer_id int, payer_id int")
    tables = {"customers": customers, "orders": orders}
    found = fks.detect(tables, facts(tables))
    assert [(k.fk_table, k.fk_column, k.pk_table) for k in found] == [("orders", "customer_id", "customers"), ("orders", "payer_id", "customers")]
    few = {"customers": customers, "orders": orders.limit(3)}
    assert fks.detect(few, facts(few)) == []
    assert len(fks.detect(few, facts(few), require_parent_le_child=False)) == 2


def test_orphans_and_hierarchy(spark):
    a = spark.createDataFrame([(i, i // 2 if i else None) for i in range(6)], "category_id int, parent_category_id int")
    tables = {"categories": a}
    found = fks.detect(tables, facts(tables))
    assert [(k.fk_column, k.relationship) for k in found] == [("parent_category_id", "hierarchy")]
    bad = {"categories": a.union(spark.createDataFrame([(9, 77)], a.schema))}
    assert fks.detect(bad, facts(bad)) == []


def test_names_only(spark):
    p = spark.createDataFrame([(1,), (2,)], "box_id int")
    c = spark.createDataFrame([(1, 2)], "item_id int, box_id int")
    found = fks.infer_by_name({"boxes": p, "items": c}, {"boxes": ("box_id",), "items": ("item_id",)}, [])
    assert [(k.fk_table, k.pk_table) for k in found] == [("items", "boxes")]


def test_type_families():
    assert fks.compatible("NUMBER(10)", "INTEGER") and fks.compatible("VARCHAR2(5)", "CHAR(1)") and not fks.compatible("DATE", "NUMBER(10)")
