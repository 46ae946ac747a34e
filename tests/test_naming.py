import re

from hypothesis import given
from hypothesis import strategies as st

from relforge.functions import graphs, naming


def test_identity():
    for name in ("customer_id", "product_code", "external_ref", "account_number", "guid", "sys_id"):
        assert naming.identity(name).strength == "high"
    assert naming.identity("id").strength == "moderate"
    assert not naming.identity("email") and not naming.identity("paid")
    assert naming.identity("paid", "compat").strength == "moderate"


def test_key_names_and_blacklist():
    assert naming.key_name("supplier_id") and not naming.key_name("supplier_id", "compat")
    assert not naming.key_name("email") and naming.key_name("o_orderkey")


def test_parent_by_name():
    assert naming.matching_parent("customer_id", ["customers", "orders"]) == "customers"
    assert naming.matching_parent("user_id", ["orders", "parts"]) is None
    assert naming.matching_parent("order_id", ["orders", "order_items"]) == "order_items"


@given(st.text(max_size=60))
def test_sanitize(name):
    out = naming.sanitize(name)
    assert re.fullmatch(r"[A-Za-z][A-Za-z0-9_]{0,29}", out)
    assert out.upper() not in naming.RESERVED
    if len(out) < naming.MAX_IDENTIFIER and not out.startswith("col_"):
        assert naming.sanitize(out) == out


def test_sanitize_examples():
    assert naming.sanitize("order") == "order_col"
    assert naming.sanitize("1st  place!") == "col_1st_place_"
    assert naming.sanitize("50_atm_transactions_transaction_time") == "col_50_atm_transactions_t_202e"


def test_cycles():
    edges = [("a", "b"), ("b", "c")]
    assert graphs.closes_cycle(edges, "c", "a") and not graphs.closes_cycle(edges, "a", "c")
    assert graphs.closes_cycle([], "a", "a") and not graphs.closes_cycle([], "a", "a", allow_self=True)
    assert graphs.ordered(["a", "b", "c"], edges) == ["c", "b", "a"]


def test_names_as_columns(spark):
    """The rules as column expressions say what the functions say."""
    from pyspark.sql import functions as F

    from relforge.functions import name_columns

    names = ["customer_id", "id", "order", "key", "paid", "monkey", "", "1st", "a--b__c", "übung", "LEVEL", "l_extendedprice_with_a_very_long_name", "x" * 31, "order_items", "Event_Lines", "unit price", "price_id", "ref 7", "guid"]
    c = F.col("name")
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", name_columns.identity_strength(c).alias("t"), name_columns.identity_strength(c, "compat").alias("c"), name_columns.business_name(c).alias("b"), name_columns.is_child_table(c).alias("k"), name_columns.is_reserved(c).alias("r"), name_columns.sanitized(c).alias("s"))
    for r in df.collect():
        n = r["name"]
        assert tuple(r)[1:] == (naming.identity(n).strength, naming.identity(n, "compat").strength, naming.business_name(n), naming.is_child_table(n), n.upper() in naming.RESERVED, naming.sanitize(n))
