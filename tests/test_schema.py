from relforge.operators import dependencies as deps
from relforge.operators import validate
from relforge.operators.foreign_keys import ForeignKey
from relforge.plans import ddl, erd, workflow


def test_validation(spark):
    a = spark.createDataFrame([(1, 9), (1, 1), (None, 1)], "a_id int, b_id int")
    b = spark.createDataFrame([(1,)], "b_id int")
    report = validate.validate({"a": a, "b": b}, {"a": ("a_id",), "b": ("b_id",)}, [ForeignKey("a", "b_id", "b", "b_id"), ForeignKey("b", "b_id", "a", "a_id")])
    text = " ".join(report.errors)
    assert not report.is_valid and "duplicate" in text and "null" in text and "cycle" in text and "1 of 2 values" in text
    assert validate.validate({"b": b}, {"b": ("b_id",)}, []).is_valid


def test_targets_and_constraints(spark):
    facts = {"p": deps.TableFacts("p", ["x_id", "y_id"], 4, {"x_id": 2, "y_id": 2}, {"x_id": 4, "y_id": 4}, [("x_id", "y_id")], ("x_id", "y_id")), "c": deps.TableFacts("c", ["x_id"], 4, {"x_id": 2}, {"x_id": 4})}
    keys = {"p": ("x_id", "y_id"), "c": ()}
    made = ddl.foreign_key_constraints([ForeignKey("c", "x_id", "p", "x_id")], keys, facts)
    assert not made.statements and "does not hold all of it" in made.skipped[0]
    assert ddl.composite_target(["x_id", "y_id"], ("x_id", "y_id"))
    made = ddl.foreign_key_constraints([ForeignKey("c", "x_id", "p", "x_id"), ForeignKey("p", "x_id", "c", "x_id")], {"p": ("x_id",), "c": ("x_id",)}, facts)
    assert len(made.statements) == 1 and "cycle" in made.skipped[0]


def test_sizes_and_nulls():
    assert ddl.sized("start_time", "VARCHAR2(3)") == "VARCHAR2(5)" and ddl.sized("name", "VARCHAR2(3)") == "VARCHAR2(3)"
    assert ddl.not_null("a", ("a",), 5, 10) and not ddl.not_null("b", (), 1, 100) and ddl.not_null("b", (), 1, 100, "compat")


def test_key_pick():
    facts = deps.TableFacts("links", ["a_id", "b_id"], 4, {"a_id": 2, "b_id": 2}, {"a_id": 4, "b_id": 4}, [("a_id", "b_id")], ("a_id", "b_id"))
    refs = [ForeignKey("links", "a_id", "a", "a_id"), ForeignKey("links", "b_id", "b", "b_id")]
    assert ddl.pick_key("links", facts, refs) == ("a_id", "b_id")


def test_whole_workflow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "customers.csv").write_text("customer_id,full_name\n" + "".join(f"{i},N {i}\n" for i in range(8)))
    (folder / "orders.csv").write_text("order_id,customer_id,tags\n" + "".join(f"{100 + i},{i % 8},a{i};b\n" for i in range(20)))
    state = workflow.run(spark, str(folder), str(tmp_path / "out"))
    assert state.status == "completed", state.errors
    found = state.normalized
    assert sorted(found.tables) == ["customers", "orders", "orders_tags"]
    assert found.tables["orders_tags"].count() == 40 and found.keys["orders"] == ("order_id",)
    assert {(k.fk_table, k.pk_table) for k in found.foreign_keys} >= {("orders", "customers")}
    assert "CREATE TABLE customers" in state.script and "REFERENCES customers(customer_id)" in state.script and state.report.is_valid
    assert "->" in state.dot and "erDiagram" in state.mermaid and "status: completed" in workflow.summary(state)
    assert (tmp_path / "out" / "schema.sql").exists()


def test_failed_workflow_says_where(spark, tmp_path):
    state = workflow.run(spark, str(tmp_path))
    assert state.status == "failed" and state.errors[0].startswith("load")


def test_erd_text():
    text = erd.dot({"a": ["a_id", "b id"]}, {"a": ("a_id",)}, [ForeignKey("a", "a_id", "a", "a_id")])
    assert text.startswith("digraph") and '"a" -> "a"' in text
