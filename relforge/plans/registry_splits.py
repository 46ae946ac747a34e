"""Queries over lossless splits, composite references and minimal dependencies, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.operators import decompose, dependencies, foreign_keys, lattice, normalize, validate
from relforge.operators.decompose import Decomposition
from relforge.operators.foreign_keys import ForeignKey
from relforge.sources.catalog import with_row_order
from relforge.sources.scratch import saved

from . import ddl
from .registry import COLUMNS, FLAT, SQL_FLAT, canonical, flat, named, query, raw

_OTHER = [c for c in FLAT if c not in ("order_id", "line_number")]
#: The flat lines in which a column says something else, so that a dependency fails in few groups.
_ODD = "order_id % 701 = 0 AND line_number = 1"


def flat_with_violations(spark: SparkSession, d: str) -> DataFrame:
    """The different flat lines (so that order and line are a key); first lines of some orders have another status (or
    none, by the customer's parity)."""
    odd = F.expr(_ODD)
    status = F.when(odd & (F.col("customer_id") % 2 == 0), F.lit("odd")).when(~odd, F.col("order_status"))
    return saved(flat(spark, d).distinct().withColumn("order_status", status), "violated")


SQL_VIOLATED = f"SELECT DISTINCT order_id, line_number, customer_id, CASE WHEN {_ODD} THEN CASE WHEN customer_id % 2 = 0 THEN 'odd' END ELSE order_status END AS order_status, {', '.join(c for c in FLAT if c not in ('order_id', 'line_number', 'customer_id', 'order_status'))} FROM ({SQL_FLAT})"
#: Rows of an order by what they say; b: what most of them say (of several the greatest, a null least).
_SQL_BEST = f"""v AS ({SQL_VIOLATED}), n AS (SELECT order_id, order_status, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT order_id, order_status FROM n QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY n DESC, order_status DESC NULLS LAST) = 1)"""


@query(f"WITH {_SQL_BEST} SELECT order_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_values, CAST(sum(n) - max(n) AS BIGINT) AS n_deviating FROM n GROUP BY order_id HAVING count(*) > 1")
def violated_groups(spark, d):
    """Orders whose lines don't agree on the status, though it depends on the order nearly everywhere."""
    return decompose.violations(flat_with_violations(spark, d), ("order_id",), "order_status")


def _decomposed(spark, d) -> tuple[DataFrame, Decomposition]:
    df = flat_with_violations(spark, d)
    facts = dependencies.measure(df, "flat")
    facts.candidate_keys, facts.primary_key = [("order_id", "line_number")], ("order_id", "line_number")
    facts.partial = dependencies.partial_dependencies(df, facts.primary_key, facts.columns)
    found = normalize.decompose("flat", with_row_order(df), facts, set())
    if not any(p.kind == "exceptions" for p in found.splits):  # in small tables no order has a line of its own
        name, key = "flat_order_id_exceptions", facts.primary_key
        none = df.where(F.lit(False)).select(*key, *_OTHER)
        found.splits.append(decompose.Piece(name, none, "flat", "exceptions", ("order_id",), tuple(_OTHER), key, decompose.reference(name, key, "flat", relationship="one-to-one")))
    return df, found


@query(f"WITH {_SQL_BEST} SELECT v.order_id, line_number, {', '.join(f'v.{c}' for c in _OTHER)} FROM v JOIN b USING (order_id) WHERE v.order_status IS DISTINCT FROM b.order_status")
def exceptions_of_a_split(spark, d):
    """The lines that deviate from their order, with their key: the split's table of exceptions."""
    _, found = _decomposed(spark, d)
    return next(p for p in found.splits if p.kind == "exceptions").df.select("order_id", "line_number", *_OTHER)


@query(f"WITH {_SQL_BEST} SELECT 0 AS lost, 0 AS added, count(*) AS n_exceptions FROM v JOIN b USING (order_id) WHERE v.order_status IS DISTINCT FROM b.order_status")
def rejoin_with_violations(spark, d):
    """The pieces of the flat table with planted violations, joined back: nothing lost, nothing made up."""
    df, found = _decomposed(spark, d)
    odd = next(p for p in found.splits if p.kind == "exceptions").df.agg(F.count("*").alias("n_exceptions"))
    return validate.difference(df, decompose.rebuilt(found)).crossJoin(F.broadcast(odd))  # one row beside one row


@query(f"""WITH v AS ({SQL_VIOLATED}), o AS (SELECT count(DISTINCT order_id) AS n FROM v), c AS (SELECT count(DISTINCT customer_id) AS n FROM v), {_SQL_BEST.replace(f'v AS ({SQL_VIOLATED}), ', '')},
e AS (SELECT count(*) AS n FROM v JOIN b USING (order_id) WHERE v.order_status IS DISTINCT FROM b.order_status)
SELECT 'flat' AS child, 'order_id' AS columns, 'flat_order_id' AS parent, n AS n_values, 0 AS n_missing, 1.0 AS coverage, 0 AS n_repeated FROM o
UNION ALL SELECT 'flat_order_id_exceptions', 'order_id+line_number', 'flat', n, 0, 1.0, 0 FROM e
UNION ALL SELECT 'flat_order_id', 'customer_id', 'customer', n, 0, 1.0, 0 FROM c""")
def references_of_a_split(spark, d):
    """Every reference that the decomposition declares, measured: all its values are there, once each."""
    _, found = _decomposed(spark, d)
    return decompose.coverage({p.name: p.df for p in found.pieces}, [p.reference for p in found.splits])


_SQL_PURCHASES = "SELECT o_orderkey AS purchase_id, c_name AS vendor, c_mktsegment AS vendor_contact, c_acctbal AS vendor_phone FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"WITH p AS ({_SQL_PURCHASES}), k AS (SELECT vendor, row_number() OVER (ORDER BY vendor) AS vendor_id FROM (SELECT DISTINCT vendor FROM p)) SELECT purchase_id, vendor_id FROM p JOIN k USING (vendor)")
def translated_keys(spark, d):
    """Orders that name their customer: the customers get a surrogate key, which takes the name's place in the orders."""
    orders, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("purchase_id"), F.col("c_name").alias("vendor"), F.col("c_mktsegment").alias("vendor_contact"), F.col("c_acctbal").alias("vendor_phone"))
    df = saved(df, "purchases")
    rest, (parent,) = decompose.split(decompose.Piece("purchases", df, "purchases", "rest", (), tuple(df.columns), ("purchase_id",)), "vendor", ("vendor",), ["vendor_contact", "vendor_phone"], "entity", ("purchase_id",))
    keyed = normalize.surrogate_key(parent.df, "vendor_id", ["vendor"])
    return decompose.translate(parent, keyed, "vendor_id", [("purchases", rest.df, parent.reference)])["purchases"][0]


# Minimal dependencies


def _sql_minimal(table: str, most: int = 3) -> str:
    """Sets of columns as bits; X gives y where both have as many different rows as X alone (nulls are values)."""
    columns = list(COLUMNS[table])
    sets = [m for m in range(1 << len(columns)) if bin(m).count("1") <= most + 1]
    named = lambda m: [c for i, c in enumerate(columns) if m >> i & 1]
    counts = " UNION ALL ".join(f"SELECT {m} AS m, count(*) AS n FROM (SELECT DISTINCT {', '.join(named(m)) or '1'} FROM {table})" for m in sets)
    names = ", ".join(f"({m}, '{'+'.join(named(m))}')" for m in sets)
    return f"""WITH c AS ({counts}), y AS (SELECT i, 1 << i AS bit, name FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(columns))}) v(i, name)),
h AS (SELECT x.m, y.bit, y.name FROM c x JOIN y ON x.m & y.bit = 0 JOIN c b ON b.m = x.m | y.bit WHERE b.n = x.n AND bit_count(x.m) <= {most})
SELECT s.name AS determinant, h.name AS dependent FROM h JOIN (VALUES {names}) s(m, name) ON s.m = h.m WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.bit = h.bit AND z.m <> h.m AND z.m & h.m = z.m)"""


for _t in ("orders", "nation", "customer", "part"):
    named(f"minimal_dependencies_{_t}", lambda s, d, t=_t: s.createDataFrame([("+".join(x.determinant), x.dependent) for x in lattice.minimal_dependencies(raw(s, d, t))], "determinant string, dependent string"), _sql_minimal(_t))


# References of several columns

#: A child of the order lines: lines that came back, with the line's key under other names, and a wrong copy of it.
_RETURNS = "SELECT DISTINCT o_key AS order_ref, l_number AS line_number, l_number + 100 AS other_number, r AS reason FROM (SELECT l_orderkey AS o_key, l_linenumber AS l_number, min(l_returnflag) AS r FROM lineitem GROUP BY ALL) WHERE r = 'R'"


def lines_and_returns(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    lines = saved(canonical(spark, d, "lineitem").groupBy("order_id", "line_number").agg(F.min("return_flag").alias("flag"), F.sum("quantity").alias("quantity")), "lines")
    returns = lines.where("flag = 'R'").select(F.col("order_id").alias("order_ref"), "line_number", (F.col("line_number") + 100).alias("other_number"), F.col("flag").alias("reason"))
    return {"lines": lines, "returns": returns, "orders": canonical(spark, d, "orders")}


def _returned(spark, d) -> tuple[dict[str, DataFrame], dict, list[ForeignKey]]:
    tables = lines_and_returns(spark, d)
    facts = dependencies.measure_all(tables)
    facts["lines"].primary_key, facts["returns"].primary_key, facts["orders"].primary_key = ("order_id", "line_number"), ("order_ref", "line_number"), ("order_id",)
    return tables, facts, foreign_keys.composite(tables, facts)


@query(f"""WITH r AS ({_RETURNS}), l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT 'returns' AS child, 'order_ref+line_number' AS columns, 'lines' AS parent, 'order_id+line_number' AS targets, count(*) AS n_values FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE (order_ref, line_number) NOT IN (SELECT (l_orderkey, l_linenumber) FROM l)) HAVING count(*) > 0""")
def composite_references(spark, d):
    """References to the composite key of the order lines, with the tuples they were found on."""
    tables, _, found = _returned(spark, d)
    counts = decompose.coverage(tables, found).select("child", "columns", "parent", "n_values")
    targets = spark.createDataFrame([(k.fk_table, k.pk_table, "+".join(k.targets)) for k in found], "child string, parent string, targets string")
    return counts.join(F.broadcast(targets), ["child", "parent"]).select("child", "columns", "parent", "targets", "n_values")


@query("""SELECT 'ALTER TABLE returns' || chr(10) || '    ADD CONSTRAINT fk_returns_1' || chr(10) || '    FOREIGN KEY (order_ref, line_number)' || chr(10) || '    REFERENCES lines(order_id, line_number);' AS statement FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) > 0
UNION ALL SELECT 'CREATE INDEX idx_returns_1 ON returns(order_ref, line_number);' FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) > 0""")
def composite_constraints(spark, d):
    """The constraints and indexes of these references."""
    _, facts, found = _returned(spark, d)
    made = ddl.foreign_key_constraints(found, {t: f.primary_key for t, f in facts.items()}, facts)
    return spark.createDataFrame([(x,) for x in made.statements + ddl.indexes(made.kept)], "statement string")


@query(f"""WITH r AS ({_RETURNS}), l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), c AS (SELECT DISTINCT other_number AS v FROM r)
SELECT 'order_ref+line_number' AS columns, true AS holds UNION ALL SELECT 'order_ref+other_number', NOT EXISTS (SELECT 1 FROM r WHERE (order_ref, other_number) NOT IN (SELECT (k, n) FROM l))
UNION ALL SELECT 'line_number+order_ref', NOT EXISTS (SELECT 1 FROM r WHERE (line_number, order_ref) NOT IN (SELECT (k, n) FROM l))""")
def inclusions_refuted_first(spark, d):
    """Tuples against the lines' key: what one in FIRST_LOOK values refutes is refuted, the rest is asked of all."""
    tables = lines_and_returns(spark, d)
    asked = [("order_ref", "line_number"), ("order_ref", "other_number"), ("line_number", "order_ref")]
    pairs = [(("returns", a), ("lines", ("order_id", "line_number"))) for a in asked]
    counts = foreign_keys._counted(tables, pairs)
    return spark.createDataFrame([("+".join(a), missing == 0) for a, (_, missing) in zip(asked, counts, strict=True)], "columns string, holds boolean")


# Lists in a field


_SQL_LISTED = "SELECT l_orderkey AS order_id, l_partkey AS part, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_returnflag) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)"


def orders_with_lists(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their parts as a JSON list of objects, of pairs with commas in them, and of flags; some have none."""
    lines = raw(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    each = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))))  # lines of one order
    lists = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(each.alias("x"))
    pairs = F.to_json(F.transform("x", lambda x: F.concat(x["part"].cast("string"), F.lit(", ["), x["flag"])))
    return saved(lists.select("order_id", F.to_json("x").alias("parts"), pairs.alias("pairs"), F.when(F.col("order_id") % 3 > 0, F.transform("x", lambda x: x["flag"])).alias("flags")), "lists")


def _listed(spark, d) -> dict[str, DataFrame]:
    return normalize.first_normal_form("orders", orders_with_lists(spark, d), ["order_id"], ["parts", "pairs", "flags"], ["order_id"])


@query(f"SELECT order_id, CAST(position AS INT) AS parts_position, flag AS parts_flag, CAST(part AS VARCHAR) AS parts_part FROM ({_SQL_LISTED})")
def lists_of_objects(spark, d):
    """A JSON list of objects as a child table: a row for each element with its position, a column for each key."""
    return _listed(spark, d)["orders_parts"].select("order_id", "parts_position", "parts_flag", "parts_part")


@query(f"SELECT 'pairs' AS list, order_id, CAST(position AS INT) AS position, part || ', [' || flag AS value FROM ({_SQL_LISTED}) UNION ALL SELECT 'flags', order_id, CAST(position AS INT), flag FROM ({_SQL_LISTED}) WHERE order_id % 3 > 0")
def lists_of_values(spark, d):
    """JSON lists of texts with delimiters and brackets inside, and arrays, as child tables."""
    found = _listed(spark, d)
    parts = [found[f"orders_{c}"].select(F.lit(c).alias("list"), "order_id", F.col(f"{c}_position").alias("position"), F.col(f"{c}_value").alias("value")) for c in ("pairs", "flags")]
    return parts[0].unionByName(parts[1])
