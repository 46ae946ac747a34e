"""Queries over the driver's tables and their DuckDB counterparts, by name."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.functions import inference, name_columns, naming
from relforge.operators import dependencies, foreign_keys, normalize, profile, validate
from relforge.operators.dependencies import TableFacts
from relforge.operators.foreign_keys import ForeignKey
from relforge.sources.scratch import saved

from . import ddl, erd

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns of the driver's relational tables and the names that the schema rules see.
COLUMNS = {
    "region": {"r_regionkey": "region_id", "r_name": "region_name"},
    "nation": {"n_nationkey": "nation_id", "n_name": "nation_name", "n_regionkey": "region_id"},
    "customer": {"c_custkey": "customer_id", "c_name": "customer_name", "c_nationkey": "nation_id", "c_acctbal": "account_balance", "c_mktsegment": "market_segment"},
    "supplier": {"s_suppkey": "supp_id", "s_name": "supp_name", "s_nationkey": "nation_id", "s_acctbal": "supp_balance"},
    "part": {"p_partkey": "part_id", "p_name": "part_name", "p_brand": "brand", "p_type": "part_type", "p_size": "part_size", "p_retailprice": "retail_price"},
    "orders": {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "order_status", "o_totalprice": "total_price", "o_orderdate": "order_date", "o_orderpriority": "order_priority"},
    "lineitem": {"l_orderkey": "order_id", "l_partkey": "part_id", "l_suppkey": "supp_id", "l_linenumber": "line_number", "l_quantity": "quantity", "l_extendedprice": "extended_price", "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag", "l_linestatus": "line_status", "l_shipdate": "ship_date"},
    "events": {"event_id": "event_id", "ts": "ts", "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props"},
}
#: Single-column keys of the canonical tables.
KEYS = {"region": "region_id", "nation": "nation_id", "customer": "customer_id", "supplier": "supp_id", "part": "part_id", "orders": "order_id", "events": "event_id"}
FOREIGN = [
    ("nation", "region_id", "region", "region_id"), ("customer", "nation_id", "nation", "nation_id"), ("supplier", "nation_id", "nation", "nation_id"),
    ("orders", "customer_id", "customer", "customer_id"), ("lineitem", "order_id", "orders", "order_id"), ("lineitem", "part_id", "part", "part_id"), ("lineitem", "supp_id", "supplier", "supp_id"),
]
TABLES = list(COLUMNS)
FLAT = ["order_id", "line_number", "customer_id", "order_status", "customer_name", "market_segment", "nation_id", "nation_name", "region_id"]


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def canonical(spark: SparkSession, d: str, name: str) -> DataFrame:
    return raw(spark, d, name).select(*[F.col(a).alias(b) for a, b in COLUMNS[name].items()])


def flat(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with what their order, customer and nation say: the wide table to be normalised, written once."""
    t = {n: canonical(spark, d, n) for n in ("lineitem", "orders", "customer", "nation")}
    joined = t["lineitem"].select("order_id", "line_number").join(t["orders"].select("order_id", "customer_id", "order_status"), "order_id").join(t["customer"].select("customer_id", "customer_name", "market_segment", "nation_id"), "customer_id").join(t["nation"], "nation_id").select(FLAT)
    return saved(joined, "flat")


def sql_canonical(name: str) -> str:
    return f"SELECT {', '.join(f'{a} AS {b}' for a, b in COLUMNS[name].items())} FROM {name}"


SQL_FLAT = "SELECT l_orderkey AS order_id, l_linenumber AS line_number, o_custkey AS customer_id, o_orderstatus AS order_status, c_name AS customer_name, c_mktsegment AS market_segment, c_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql is not None:
        ORACLE_SQL[name] = sql


# Profiles


def _sql_profile(source: str, table: str, columns: list[str]) -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM src"
    return f"""WITH src AS ({source}), p AS ({' UNION ALL '.join(one.format(t=table, c=c) for c in columns)})
SELECT table_name, column_name, n AS total_count, n - k AS null_count, k AS non_null_count, u AS unique_count,
       CASE WHEN n > 0 THEN (n - k) / n ELSE 0.0 END AS null_ratio, CASE WHEN n > 0 THEN u / n ELSE 0.0 END AS uniqueness_ratio,
       CASE WHEN n > 0 AND u / n > 0.95 THEN 'high' WHEN n > 0 AND u / n > 0.5 THEN 'medium' WHEN u < 50 THEN 'low' ELSE 'medium' END AS cardinality FROM p"""


for _t in ("lineitem", "orders", "events", "customer", "part"):
    named(f"column_profile_{_t}", lambda s, d, t=_t: profile.column_profile(raw(s, d, t), t), _sql_profile(f"SELECT * FROM {_t}", _t, list(COLUMNS[_t])))


#: Columns of orders with nulls put in where the key is a multiple of the number.
INJECTED = {"o_orderstatus": 2, "o_totalprice": 7, "o_orderpriority": 200, "o_custkey": 15}


def injected(spark: SparkSession, d: str) -> DataFrame:
    df = raw(spark, d, "orders")
    return df.select(*[F.when(F.col("o_orderkey") % INJECTED[c] != 0, F.col(c)).alias(c) if c in INJECTED else F.col(c) for c in df.columns])


SQL_INJECTED = "SELECT " + ", ".join(f"CASE WHEN o_orderkey % {INJECTED[c]} <> 0 THEN {c} END AS {c}" if c in INJECTED else c for c in COLUMNS["orders"]) + " FROM orders"

named("column_profile_injected_nulls", lambda s, d: profile.column_profile(injected(s, d), "orders"), _sql_profile(SQL_INJECTED, "orders", list(COLUMNS["orders"])))


@query(f"""WITH p AS ({_sql_profile(SQL_INJECTED, 'orders', list(COLUMNS['orders']))}) SELECT column_name, null_ratio,
CASE WHEN null_ratio < 0.01 THEN 'NOT NULL' WHEN null_ratio < 0.1 THEN 'NULLABLE - Consider default value' WHEN null_ratio < 0.5 THEN 'NULLABLE - Common'
ELSE 'NULLABLE - High null ratio, consider redesign' END AS strategy FROM p""")
def null_strategy_injected(spark, d):
    return profile.column_profile(injected(spark, d), "orders").select("column_name", "null_ratio", inference.null_strategy(F.col("null_ratio")).alias("strategy"))


@query("""SELECT 'c_mktsegment' AS column_name, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS default_value
UNION ALL SELECT 'c_nationkey', CAST(median(c_nationkey) AS VARCHAR) FROM customer UNION ALL SELECT 'p_brand', (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def default_suggestion(spark, d):
    c, p = raw(spark, d, "customer"), raw(spark, d, "part")
    return profile.default_value(c, "c_mktsegment").unionByName(profile.default_value(c, "c_nationkey")).unionByName(profile.default_value(p, "p_brand"))


def _sql_type(table: str, column: str, kind: str) -> str:
    if kind == "int":
        value = f"CASE WHEN max({column}) <= 2147483647 THEN 'NUMBER(10)' ELSE 'NUMBER(19)' END"
    elif kind == "text":
        words = ", ".join(f"'{w}'" for w in inference.BOOLEAN_TEXTS)
        value = f"CASE WHEN bool_and(lower({column}) IN ({words})) THEN 'CHAR(1)' WHEN max(length({column})) < 1 THEN 'VARCHAR2(255)' ELSE 'VARCHAR2(' || CAST(least(CAST(floor(max(length({column})) * 1.5) AS INT), 4000) AS VARCHAR) || ')' END"
    else:
        value = {"double": "'NUMBER(15,2)'", "timestamp": "'TIMESTAMP'"}[kind]
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, CASE WHEN count({column}) = 0 THEN 'VARCHAR2(4000)' ELSE {value} END AS oracle_type FROM {table}"


_KINDS = {"int": "key custkey nationkey size linenumber user_id event_id".split(), "double": "acctbal price quantity discount tax value".split(), "timestamp": ["date", "ts"]}


def _kind(column: str) -> str:
    return next((k for k, ends in _KINDS.items() if any(column.endswith(e) for e in ends)), "text")


@query(" UNION ALL ".join(_sql_type(t, c, _kind(c)) for t in TABLES for c in COLUMNS[t]))
def oracle_types_all(spark, d):
    out = None
    for t in TABLES:
        part = profile.oracle_types(raw(spark, d, t), t)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""SELECT 'lineitem' AS table_name, c AS column_name, coalesce(bool_and(lower(v) IN ({', '.join(f"'{w}'" for w in inference.BOOLEAN_TEXTS)})), false) AS is_boolean_like FROM (
SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem) GROUP BY c""")
def boolean_like_columns(spark, d):
    return profile.boolean_like(raw(spark, d, "lineitem"), "lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"])


def _sql_multi(table: str, column: str, order: str) -> str:
    tests = " OR ".join(f"count(*) FILTER (contains(v, {q})) > 0.3 * count(*)" for q in ("','", "';'", "'|'", "'/'", "':'", "chr(10)", "chr(9)"))
    return f"SELECT '{table}' AS table_name, '{column}' AS column_name, coalesce({tests} OR count(*) FILTER (regexp_matches(v, '[\\[\\{{].*[\\]\\}}]')) > 0.3 * count(*), false) AS is_multivalued FROM (SELECT {column} AS v FROM {table} WHERE {column} IS NOT NULL ORDER BY {order} LIMIT 100)"


@query(" UNION ALL ".join(_sql_multi(*a) for a in (("pages", "url", "page_id"), ("events", "props", "event_id"), ("events", "event_type", "event_id"), ("part", "p_name", "p_partkey"), ("documents", "lang", "doc_id"))))
def multivalued_flags(spark, d):
    out = profile.multivalued(raw(spark, d, "pages"), "pages", ["url"], ["page_id"])
    out = out.unionByName(profile.multivalued(raw(spark, d, "events"), "events", ["props", "event_type"], ["event_id"]))
    return out.unionByName(profile.multivalued(raw(spark, d, "part"), "part", ["p_name"], ["p_partkey"])).unionByName(profile.multivalued(raw(spark, d, "documents"), "documents", ["lang"], ["doc_id"]))


@query("SELECT avg(CASE WHEN json_valid(v) AND regexp_matches(v, '^\\s*[\\[\\{]') THEN 1 ELSE 0 END) AS share, coalesce(avg(CASE WHEN json_valid(v) AND regexp_matches(v, '^\\s*[\\[\\{]') THEN 1 ELSE 0 END) > 0.7, false) AS is_json FROM (SELECT props AS v FROM events WHERE props IS NOT NULL ORDER BY event_id LIMIT 10)")
def json_detect_events(spark, d):
    return profile.json_shape(raw(spark, d, "events"), "props", ["event_id"])


@query("SELECT k AS json_key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_keys_events(spark, d):
    return profile.json_keys(raw(spark, d, "events"), "props")


@query("SELECT mean_blanks, CASE WHEN mean_blanks BETWEEN 1 AND 3 THEN CASE WHEN mean_blanks > 1.5 THEN 'first+middle+last' ELSE 'first+last' END ELSE '' END AS components FROM (SELECT avg(length(p_name) - length(replace(p_name, ' ', ''))) AS mean_blanks FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 50))")
def fullname_space_count(spark, d):
    return profile.full_name_shape(raw(spark, d, "part"), "p_name", ["p_partkey"])


SQL_ADDRESSES = "SELECT c_custkey, CAST(c_custkey AS VARCHAR) || ' ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' St, Springfield, CA ' || CAST(10000 + c_custkey AS VARCHAR) ELSE '' END AS address FROM customer"


@query(f"""SELECT street, city, state, zip, street > 0.5 OR (city > 0.3 AND (state > 0.3 OR zip > 0.3)) AS is_address FROM (SELECT avg(CAST(regexp_matches(address, '\\d+\\s+[A-Za-z]+') AS INT)) AS street,
avg(CAST(regexp_matches(address, ',\\s*[A-Z][a-z]+') AS INT)) AS city, avg(CAST(regexp_matches(address, '\\b[A-Z]{{2}}\\b') AS INT)) AS state, avg(CAST(regexp_matches(address, '\\b\\d{{5}}(-\\d{{4}})?\\b') AS INT)) AS zip
FROM (SELECT * FROM ({SQL_ADDRESSES}) ORDER BY c_custkey LIMIT 50))""")
def address_regex_hits(spark, d):
    end = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" St, Springfield, CA "), (F.col("c_custkey") + 10000).cast("string"))).otherwise("")
    df = raw(spark, d, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment", end).alias("address"))
    return profile.address_shape(df, "address", ["c_custkey"])


@query(" UNION ALL ".join(f"SELECT 'nation' AS table_name, '{c}' AS column_name, row_number() OVER (ORDER BY n_nationkey) AS position, CAST({c} AS VARCHAR) AS value FROM nation WHERE {c} IS NOT NULL QUALIFY position <= 5" for c in ("n_name", "n_regionkey")))
def sample_values(spark, d):
    return profile.sample_values(raw(spark, d, "nation"), "nation", ["n_name", "n_regionkey"], ["n_nationkey"])


def _sql_pair(a: str, b: str, t1: str, t2: str) -> str:
    return f"""WITH x AS (SELECT DISTINCT CAST({a} AS VARCHAR) AS v FROM {t1} WHERE {a} IS NOT NULL), y AS (SELECT DISTINCT CAST({b} AS VARCHAR) AS v FROM {t2} WHERE {b} IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM x) AS unique_1, (SELECT count(*) FROM y) AS unique_2, (SELECT count(*) FROM x JOIN y USING (v)) AS overlap)
SELECT *, CASE WHEN least(unique_1, unique_2) > 0 THEN overlap / least(unique_1, unique_2) ELSE 0.0 END AS overlap_ratio, CASE WHEN least(unique_1, unique_2) = 0 THEN 'unknown'
WHEN unique_1 > 5 * unique_2 THEN 'many-to-one' WHEN unique_2 > 5 * unique_1 THEN 'one-to-many' ELSE 'many-to-many' END AS relationship FROM n"""


@query(_sql_pair("o_custkey", "c_nationkey", "orders", "customer"))
def column_pair_relation(spark, d):
    return profile.column_pair(raw(spark, d, "orders"), "o_custkey", raw(spark, d, "customer"), "c_nationkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN regexp_matches('{c}', 'id|key|code|number') THEN 'identifiers' WHEN regexp_matches('{c}', 'name|description|title|label') THEN 'descriptive' WHEN regexp_matches('{c}', 'date|time|timestamp|created|updated') THEN 'temporal' WHEN regexp_matches('{c}', 'amount|quantity|price|total|count') THEN 'quantitative' WHEN count(DISTINCT {c}) < 50 THEN 'categorical' ELSE 'other' END AS role FROM {t}" for t in ("customer", "orders", "part") for c in COLUMNS[t]))
def column_roles(spark, d):
    facts = dependencies.measure_all({t: raw(spark, d, t) for t in ("customer", "orders", "part")})
    found = [(t, c, naming.role(c, f.unique[c])) for t, f in facts.items() for c in f.columns]
    return spark.createDataFrame(found, "table_name string, column_name string, role string")


# Dependencies and keys


def _sql_ratio(x: tuple[str, ...], y: str, where: str = "") -> str:
    return f"SELECT '{'+'.join(x)}' AS determinant, '{y}' AS dependent, coalesce(avg(CASE WHEN u = 1 THEN 1.0 ELSE 0.0 END), 1.0) AS ratio FROM (SELECT count(DISTINCT {y}) AS u FROM src {where} GROUP BY {', '.join(x)})"


def _sql_matrix(source: str, columns: list[str]) -> str:
    return f"WITH src AS ({source}) " + " UNION ALL ".join(_sql_ratio((x,), y) for x in columns for y in columns if x != y)


for _t in ("customer", "orders", "lineitem", "part"):
    named(f"fd_matrix_{_t}", lambda s, d, t=_t: dependencies.fd_matrix(raw(s, d, t)), _sql_matrix(f"SELECT * FROM {_t}", list(COLUMNS[_t])))


@query(f"SELECT * FROM ({_sql_matrix(SQL_FLAT, FLAT)}) WHERE ratio = 1")
def fd_exact_flat(spark, d):
    return dependencies.fd_matrix(flat(spark, d)).where("ratio = 1")


@query("WITH src AS (" + SQL_INJECTED + ") SELECT 'kept' AS nulls, * FROM (" + _sql_ratio(("o_custkey",), "o_orderstatus") + ") UNION ALL SELECT 'dropped', * FROM (" + _sql_ratio(("o_custkey",), "o_orderstatus", "WHERE o_custkey IS NOT NULL") + ")")
def fd_null_determinant(spark, d):
    df = injected(spark, d)
    both = [dependencies.ratios(df, [("o_custkey",)], ["o_orderstatus"], drop).select(F.lit(word).alias("nulls"), "*") for word, drop in (("kept", False), ("dropped", True))]
    return both[0].unionByName(both[1])


def _sql_free(source: str, columns: list[str], sizes: tuple[int, ...], keep=lambda s: True) -> str:
    """s (a list of columns) and free (whether no combination of values repeats), for sets of the given sizes."""
    return " UNION ALL ".join(f"SELECT {i} AS i, {list(s)!r} AS s, count(*) FILTER (n > 1) = 0 AS free FROM (SELECT count(*) AS n FROM ({source}) GROUP BY {', '.join(s)})" for i, s in enumerate(s for n in sizes for s in combinations(columns, n) if keep(s)))


@query(f"WITH f AS ({_sql_free('SELECT * FROM lineitem', list(COLUMNS['lineitem']), (1, 2, 3))}) SELECT array_to_string(s, '+') AS columns FROM f WHERE free AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.free AND len(g.s) < len(f.s) AND list_has_all(f.s, g.s))")
def unique_column_sets_lineitem(spark, d):
    df = raw(spark, d, "lineitem")
    facts = dependencies.measure(df, "lineitem")
    found = dependencies.unique_sets(df, facts.columns, {c: (facts.unique[c], facts.non_null[c]) for c in facts.columns}, facts.n_rows)
    return spark.createDataFrame([("+".join(s),) for s in found], "columns string")


def _sql_keys(table: str, source: str, columns: list[str]) -> str:
    """table_name, key: singles with a key's name, else the smallest sets that hold a part of an identifier."""
    singles = [c for c in columns if naming.key_name(c)]
    one = " UNION ALL ".join(f"SELECT {i} AS i, ['{c}'] AS s, count(*) = count(DISTINCT {c}) AND count(*) > 0 AS free FROM ({source})" for i, c in enumerate(singles)) or "SELECT 0 AS i, [''] AS s, false AS free"
    more = _sql_free(source, columns, (2, 3), lambda s: any(naming.has_any(c, naming.IDENTITY_PARTS) for c in s)) or "SELECT 0 AS i, ['', ''] AS s, false AS free"
    return f"SELECT '{table}' AS table_name, array_to_string(s, '+') AS key, i FROM (SELECT *, min(len(s)) OVER () AS least FROM ({one} UNION ALL {more}) WHERE free) WHERE len(s) = least"


_SQL_KEYS = " UNION ALL ".join(_sql_keys(t, sql_canonical(t), list(COLUMNS[t].values())) for t in TABLES)


@query(f"SELECT table_name, key FROM ({_SQL_KEYS})")
def candidate_keys_all(spark, d):
    return _key_rows(spark, _facts(spark, d))


def _key_rows(spark, facts: dict[str, TableFacts]) -> DataFrame:
    return spark.createDataFrame([(t, "+".join(k)) for t, f in facts.items() for k in f.candidate_keys], "table_name string, key string")


@query(f"SELECT table_name, key FROM ({_sql_keys('conversations', 'SELECT * FROM conversations', ['conv_id', 'turn', 'role', 'text'])})")
def composite_keys_conversations(spark, d):
    df = raw(spark, d, "conversations")
    facts = dependencies.measure(df, "conversations")
    facts.candidate_keys = dependencies.candidate_keys(df, facts)
    return _key_rows(spark, {"conversations": facts})


@query(f"SELECT table_name, min_by(key, i) AS primary_key FROM ({_SQL_KEYS}) GROUP BY table_name")
def primary_keys_all(spark, d):
    found = [(t, "+".join(f.primary_key)) for t, f in _facts(spark, d).items()]
    return spark.createDataFrame(found, "table_name string, primary_key string")


_PARTS = [("order_id",), ("line_number",)]


@query(f"WITH src AS ({SQL_FLAT}) SELECT determinant, dependent FROM (" + " UNION ALL ".join(_sql_ratio(x, y) for x in _PARTS for y in FLAT if y not in ("order_id", "line_number")) + ") WHERE ratio >= 0.99")
def partial_deps_flat(spark, d):
    found = dependencies.partial_dependencies(flat(spark, d), ("order_id", "line_number"), FLAT)
    return spark.createDataFrame([('+'.join(part), c) for part, columns in found.items() for c in columns], "determinant string, dependent string")


SQL_ORDERS_FLAT = f"SELECT DISTINCT {', '.join(c for c in FLAT if c != 'line_number')} FROM ({SQL_FLAT})"
_ORDER_COLUMNS = [c for c in FLAT if c != "line_number"]
_MIDDLE = [c for c in _ORDER_COLUMNS if c != "order_id"]


def orders_flat(spark: SparkSession, d: str) -> DataFrame:
    return saved(flat(spark, d).select(_ORDER_COLUMNS).distinct(), "orders_flat")


def orders_facts(df: DataFrame) -> TableFacts:
    facts = dependencies.measure(df, "flat")
    facts.candidate_keys, facts.primary_key = [("order_id",)], ("order_id",)
    return facts


def _any(words) -> str:
    return "|".join(words)


#: determinant, u (distinct values), n (rows); exact and nearly exact dependents of the flat orders' columns.
_SQL_COUNTS = f"u AS ({' UNION ALL '.join(f"SELECT '{c}' AS determinant, count(DISTINCT {c}) AS u, count(*) AS n FROM src" for c in _MIDDLE)})"


@query(f"""WITH src AS ({SQL_ORDERS_FLAT}), m AS ({' UNION ALL '.join(_sql_ratio((x,), y) for x in _ORDER_COLUMNS for y in _MIDDLE if x != y)}), {_SQL_COUNTS},
t AS (SELECT b.determinant AS a, list(b.dependent) AS deps, any_value(u.u) AS u, any_value(u.n) AS n, replace(b.determinant, '_id', '') AS base FROM m a JOIN m b ON a.determinant = 'order_id' AND a.dependent = b.determinant JOIN u ON u.determinant = b.determinant
      WHERE a.ratio >= 0.99 AND b.ratio >= 0.99 AND u.u < u.n GROUP BY b.determinant)
SELECT a AS middle, unnest(deps) AS target FROM t WHERE NOT (len(deps) = 1 AND regexp_matches(deps[1], '{_any(naming.NAME_WORDS)}') AND contains(deps[1], base)) AND u >= 10 AND u >= 0.05 * n
AND (NOT regexp_matches(a, '{_any(naming.CATEGORICAL_WORDS)}') OR regexp_matches(a, '{_any(naming.ENTITY_WORDS)}'))
AND ((regexp_matches(a, '{_any(naming.ENTITY_WORDS)}') AND len(deps) >= 2) OR regexp_matches(array_to_string(deps, ' '), '{_any(naming.CONTACT_WORDS)}') OR len(deps) >= 3)""")
def transitive_deps_flat(spark, d):
    df = orders_flat(spark, d)
    found = dependencies.transitive_dependencies(df, orders_facts(df))
    return spark.createDataFrame([(a, b) for _, a, targets in found for b in targets], "middle string, target string")


_WORDY = [c for c in _MIDDLE if set(c.split("_")) - set(naming.COMMON_WORDS)]


@query(f"""WITH src AS ({SQL_ORDERS_FLAT}), m AS ({' UNION ALL '.join(_sql_ratio((x,), y, f'WHERE {x} IS NOT NULL') for x in _MIDDLE for y in _MIDDLE if x != y)}), {_SQL_COUNTS},
f AS (SELECT determinant, count(*) FILTER (ratio = 1) AS k, bool_or(ratio = 1 AND dependent IN {tuple(_WORDY)}) OR determinant IN {tuple(_WORDY)} AS wordy, bool_or(ratio = 1 AND regexp_matches(dependent, '{_any(naming.STRUCTURAL_WORDS)}')) AS contact FROM m GROUP BY determinant),
s AS (SELECT determinant AS column_name, u AS unique_count, k AS n_dependents, contact, u / n AS r, CASE WHEN u < greatest(10, 0.01 * n) OR u / n < 0.02 OR k = 0 THEN 0.0 ELSE round((CASE WHEN k >= 3 THEN 0.5 WHEN k = 2 THEN 0.3 ELSE 0.1 END) + (CASE WHEN u / n BETWEEN 0.05 AND 0.7 THEN 0.2 WHEN u / n BETWEEN 0.02 AND 0.9 THEN 0.1 ELSE 0 END)
 + CASE WHEN wordy THEN 0.2 ELSE 0 END + CASE WHEN contact THEN 0.3 ELSE 0 END, 6) END AS score FROM f JOIN u USING (determinant))
SELECT column_name, unique_count, n_dependents, score, score >= 0.4 AS is_entity, CASE WHEN score < 0.4 THEN '' WHEN r > 0.5 THEN 'master' WHEN contact THEN 'reference' ELSE 'lookup' END AS kind FROM s""")
def entity_scores_flat(spark, d):
    df = orders_flat(spark, d)
    facts = orders_facts(df)
    exact = dependencies.collect_ratios(df.select(_MIDDLE), [(c,) for c in _MIDDLE], drop_null_determinants=True, at_least=1)
    out = []
    for c in _MIDDLE:
        diverse = [y for y in _MIDDLE if exact.get(((c,), y), 0) == 1]
        e = normalize.entity_score(facts.unique[c], facts.n_rows, c, diverse)
        out.append((c, facts.unique[c], len(diverse), e.score, e.is_entity, e.kind))
    return spark.createDataFrame(out, "column_name string, unique_count long, n_dependents long, score double, is_entity boolean, kind string")


#: (name that the rule sees, table, its columns, column that repeats, what the names say; status: if some value varies).
_REPEATS = [
    ("orders", "orders", ["o_orderkey", "o_custkey", "o_orderdate"], "o_custkey", "event_history"),
    ("orders", "orders", ["o_orderkey", "o_custkey", "o_orderdate"], "o_orderkey", "event_history"),
    ("sales", "orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_custkey", "status_history"),
    ("part", "part", ["p_partkey", "p_brand"], "p_brand", "line_items"),
    ("rows", "lineitem", ["l_orderkey", "l_linenumber"], "l_orderkey", "sequenced_children"),
    ("customer", "customer", ["c_custkey", "c_nationkey"], "c_nationkey", "child_records"),
]


def _sql_repeats(name: str, table: str, columns: list[str], column: str, kind: str) -> str:
    if kind == "status_history":
        kind = f"' || CASE WHEN EXISTS (SELECT 1 FROM {table} GROUP BY {column} HAVING count(DISTINCT o_orderstatus) > 1) THEN 'status_history' ELSE 'sequenced_children' END || '"
    return f"SELECT '{name}' AS name, '{column}' AS column_name, CASE WHEN count(*) = count(DISTINCT {column}) THEN 'none' ELSE '{kind}' END AS pattern FROM {table}"


@query(" UNION ALL ".join(_sql_repeats(*r) for r in _REPEATS))
def multi_row_patterns(spark, d):
    out = []
    for name, table, columns, column, _ in _REPEATS:
        df = raw(spark, d, table).select(columns)
        found = normalize.multi_row_pattern(df, name, column, dependencies.measure(df, name))
        out.append((name, column, found.kind if found else "none"))
    return spark.createDataFrame(out, "name string, column_name string, pattern string")


# Foreign keys

_PAIRS = [(t, c, p, k) for t in TABLES for c in COLUMNS[t].values() for p, k in KEYS.items() if p != t and naming.foreign_key_name(c) and c != KEYS.get(t)]


def _sql_inclusion(pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS fk_table, '{c}' AS fk_column, '{p}' AS pk_table, '{k}' AS pk_column, count(*) AS n_values, count(*) FILTER (v NOT IN (SELECT CAST({k} AS VARCHAR) FROM ({sql_canonical(p)}))) AS n_missing FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM ({sql_canonical(t)}) WHERE {c} IS NOT NULL)" for t, c, p, k in pairs)


def _canonicals(spark, d) -> dict[str, DataFrame]:
    return {t: canonical(spark, d, t) for t in TABLES}


@query(_sql_inclusion(_PAIRS))
def ind_coverage_all(spark, d):
    return foreign_keys.inclusion(_canonicals(spark, d), _PAIRS)


def _facts(spark, d) -> dict[str, TableFacts]:
    """Measures and keys of the canonical tables."""
    tables = _canonicals(spark, d)
    out = dependencies.measure_all(tables)
    for t, f in out.items():
        f.candidate_keys = dependencies.candidate_keys(tables[t], f)
        f.primary_key = min(f.candidate_keys, key=len) if f.candidate_keys else ()
    return out


def _fk_rows(spark, keys: list[ForeignKey]) -> DataFrame:
    return spark.createDataFrame([(k.fk_table, k.fk_column, k.pk_table, k.pk_column) for k in keys], "fk_table string, fk_column string, pk_table string, pk_column string")


def _sql_fits() -> str:
    return f"""WITH ind AS ({_sql_inclusion(_PAIRS)}), n AS ({' UNION ALL '.join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TABLES)}),
own AS (SELECT string_split(min_by(key, i), '+') AS k FROM ({_sql_keys('lineitem', sql_canonical('lineitem'), list(COLUMNS['lineitem'].values()))})),
fits AS (SELECT ind.* FROM ind JOIN n c ON c.t = fk_table JOIN n p ON p.t = pk_table WHERE n_values > 0 AND n_missing = 0 AND p.n <= c.n AND NOT (fk_table = 'lineitem' AND list_contains((SELECT k FROM own), fk_column))),
based AS (SELECT *, replace(fk_column, '_id', '') AS base, count(*) OVER (PARTITION BY fk_table, fk_column) AS parents FROM fits)"""


@query(_sql_fits() + """ SELECT fk_table, fk_column, pk_table, pk_column FROM (SELECT *, row_number() OVER (PARTITION BY fk_table, fk_column ORDER BY length(pk_table) DESC, pk_table) AS r FROM based WHERE parents = 1 OR contains(pk_table, base) OR contains(base, pk_table)) WHERE r = 1""")
def foreign_keys_detected(spark, d):
    return _fk_rows(spark, _detected(spark, d)[0])


def _detected(spark, d) -> tuple[list[ForeignKey], dict[str, TableFacts]]:
    facts = _facts(spark, d)
    return foreign_keys.detect(_canonicals(spark, d), facts), facts


@query(f"WITH ind AS ({_sql_inclusion(_PAIRS)}), n AS ({' UNION ALL '.join(f'''SELECT '{t}' AS t, count(*) AS n FROM {t}''' for t in TABLES)}) SELECT fk_table, fk_column, pk_table, c.n AS child_rows, p.n AS parent_rows FROM ind JOIN n c ON c.t = fk_table JOIN n p ON p.t = pk_table WHERE n_values > 0 AND n_missing = 0 AND p.n > c.n")
def fk_rule3_rejections(spark, d):
    tables = _canonicals(spark, d)
    counts = None
    for t, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
        counts = part if counts is None else counts.unionByName(part)
    ind = foreign_keys.inclusion(tables, _PAIRS).where("n_values > 0 AND n_missing = 0")
    child, parent = counts.select(F.col("t").alias("fk_table"), F.col("n").alias("child_rows")), counts.select(F.col("t").alias("pk_table"), F.col("n").alias("parent_rows"))
    return ind.join(F.broadcast(child), "fk_table").join(F.broadcast(parent), "pk_table").where("parent_rows > child_rows").select("fk_table", "fk_column", "pk_table", "child_rows", "parent_rows")


SQL_HIERARCHY = "SELECT n_nationkey AS nation_id, n_name AS nation_name, CASE WHEN n_nationkey >= 5 THEN n_regionkey END AS parent_nation_id FROM nation"


@query(f"WITH h AS ({SQL_HIERARCHY}) SELECT 'nation' AS fk_table, 'parent_nation_id' AS fk_column, 'nation' AS pk_table, 'nation_id' AS pk_column WHERE (SELECT count(parent_nation_id) FROM h) > 0 AND NOT EXISTS (SELECT 1 FROM h WHERE parent_nation_id IS NOT NULL AND parent_nation_id NOT IN (SELECT nation_id FROM h))")
def self_fk_hierarchy(spark, d):
    h = raw(spark, d, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation_name"), F.when(F.col("n_nationkey") >= 5, F.col("n_regionkey")).alias("parent_nation_id"))
    f = dependencies.measure(h, "nation")
    f.primary_key = ("nation_id",)
    return _fk_rows(spark, foreign_keys.detect({"nation": h}, {"nation": f}))


# Normalisation


@query("SELECT page_id, unnest(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')) AS url_value FROM pages WHERE url IS NOT NULL")
def explode_url_segments(spark, d):
    return normalize.explode_values(raw(spark, d, "pages"), "url", ["page_id"], "/")


@query(" UNION ALL ".join(f"SELECT '{x}' AS delimiter, {i} AS rank, count(*) FILTER (contains(url, '{x}')) AS n_rows FROM (SELECT url FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 100)" for i, x in enumerate(inference.SPLIT_DELIMITERS)))
def delimiter_choice(spark, d):
    return normalize.delimiter_counts(raw(spark, d, "pages"), "url", ["page_id"])


def _second(spark, d) -> dict[str, DataFrame]:
    return normalize.second_normal_form("flat", flat(spark, d), {("order_id",): [c for c in FLAT if c not in ("order_id", "line_number")]})


@query(f"SELECT DISTINCT {', '.join(_ORDER_COLUMNS)} FROM ({SQL_FLAT})")
def decompose_2nf_orders(spark, d):
    return _second(spark, d)["flat_order_id"].select(_ORDER_COLUMNS)


@query(f"SELECT order_id, line_number FROM ({SQL_FLAT})")
def decompose_2nf_rest(spark, d):
    return _second(spark, d)["flat"]


@query(f"SELECT DISTINCT customer_id, customer_name, market_segment, nation_id FROM ({SQL_FLAT})")
def decompose_3nf_customer(spark, d):
    return normalize.related_table(orders_flat(spark, d), "customer_id", ["customer_name", "market_segment", "nation_id"])[0]


@query(f"SELECT DISTINCT nation_id, nation_name, region_id FROM ({SQL_FLAT})")
def decompose_3nf_customer_nation(spark, d):
    return normalize.related_table(orders_flat(spark, d), "nation_id", ["nation_name", "region_id"])[0]


@query("SELECT c_custkey AS customer_id, c_name AS customer_name, m.market_segment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, c_mktsegment AS market_segment FROM orders JOIN customer ON o_custkey = c_custkey) m ON m.o_custkey = c_custkey")
def fact_dim_move(spark, d):
    c = canonical(spark, d, "customer")
    child = canonical(spark, d, "orders").select("order_id", "customer_id").join(c.select("customer_id", "market_segment"), "customer_id")
    tables = {"customer": c.select("customer_id", "customer_name"), "orders": child}
    moved = normalize.move_to_parent(tables, {"customer": ("customer_id",), "orders": ("order_id",)}, [ForeignKey("orders", "customer_id", "customer", "customer_id")])
    return moved["customer"].select("customer_id", "customer_name", "market_segment")


_LINE_ORDER = list(COLUMNS["lineitem"])


@query(f"SELECT row_number() OVER (ORDER BY {', '.join(_LINE_ORDER)}) AS lineitem_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def surrogate_key_lineitem(spark, d):
    return normalize.surrogate_key(raw(spark, d, "lineitem"), "lineitem_id", _LINE_ORDER).select("lineitem_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS orders_id, o_orderkey, o_custkey FROM orders")
def surrogate_key_one_column(spark, d):
    return normalize.surrogate_key(raw(spark, d, "orders"), "orders_id", ["o_orderkey"]).select("orders_id", "o_orderkey", "o_custkey")


@query("SELECT count(*) AS n_rows, count(*) AS n_keys, CAST(1 AS BIGINT) AS least, count(*) AS most FROM lineitem")
def surrogate_key_with_ties(spark, d):
    keyed = normalize.surrogate_key(raw(spark, d, "lineitem"), "lineitem_id", ["l_orderkey"])
    return keyed.agg(F.count("*").alias("n_rows"), F.count_distinct("lineitem_id").alias("n_keys"), F.min("lineitem_id").alias("least"), F.max("lineitem_id").alias("most"))


# Validation


@query("SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS added")
def rejoin_lossless(spark, d):
    df, pieces = flat(spark, d), _second(spark, d)
    return validate.rejoin_difference(df, [(pieces["flat"], []), (pieces["flat_order_id"], ["order_id"])])


_KEYED = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "nation": ("n_nationkey",), "events": ("event_id",)}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{'+'.join(k)}' AS key, count(*) FILTER (n > 1) AS duplicates, CAST(coalesce(sum(n) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}), 0) AS BIGINT) AS nulls FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY {', '.join(k)})" for t, k in _KEYED.items()))
def pk_violations(spark, d):
    return validate.key_violations({t: raw(spark, d, t) for t in _KEYED}, _KEYED)


_PRUNED = "SELECT * FROM orders WHERE o_orderkey % 10 <> 0"


@query(f"WITH c AS (SELECT DISTINCT l_orderkey AS v FROM lineitem) SELECT count(*) AS n_values, count(*) FILTER (v NOT IN (SELECT o_orderkey FROM ({_PRUNED}))) AS n_missing FROM c")
def fk_orphans(spark, d):
    tables = {"lineitem": canonical(spark, d, "lineitem"), "orders": canonical(spark, d, "orders").where("order_id % 10 <> 0")}
    return validate.orphans(tables, [ForeignKey("lineitem", "order_id", "orders", "order_id")]).select("n_values", "n_missing")


@query("SELECT fk_table, fk_column, pk_table, pk_column, n_values, n_missing, CASE WHEN n_values > 0 THEN 1 - n_missing / n_values ELSE 1.0 END AS coverage FROM (" + _sql_inclusion(FOREIGN) + ")")
def fk_coverage(spark, d):
    return validate.orphans(_canonicals(spark, d), [ForeignKey(*k) for k in FOREIGN])


@query(f"SELECT avg(CAST(contains(address, ',') AS INT)) AS share, avg(CAST(contains(address, ',') AS INT)) > 0.5 AS is_concatenated FROM (SELECT address FROM ({SQL_ADDRESSES}) ORDER BY c_custkey LIMIT 10)")
def concat_address_warning(spark, d):
    end = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" St, Springfield, CA "), (F.col("c_custkey") + 10000).cast("string"))).otherwise("")
    df = raw(spark, d, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment", end).alias("address"))
    return validate.address_hint(df, "address", ["c_custkey"])


# DDL

#: Names in the data: values of the tables as column or table names of a catalog, some with an ending.
_NAMED = [
    ("part", "p_type"), ("part", "p_brand || ' items'"), ("part", "p_name || ' of ' || p_type"), ("events", "event_type"), ("events", "event_type || '_id'"), ("events", "event_type || '_history'"), ("nation", "lower(n_name) || 'key'"), ("region", "r_name || ' code'"), ("orders", "o_orderpriority"),
    ("orders", "'level' || o_orderstatus"), ("customer", "lower(c_mktsegment) || '_price'"), ("customer", "c_mktsegment || '_log'"), ("lineitem", "concat('DATE', substr('x', 1, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END))"), ("documents", "'ref ' || lang"), ("documents", "lang || 'order'"), ("documents", "source || '_status'"),
]


def names_in_data(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, e in _NAMED:
        part = raw(spark, d, t).select(F.expr(e).alias("name")).where("name IS NOT NULL").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


SQL_NAMES = "SELECT DISTINCT name FROM (" + " UNION ALL ".join(f"SELECT DISTINCT {e} AS name FROM {t}" for t, e in _NAMED) + ") WHERE name IS NOT NULL"


def _sql_sanitize(c: str) -> str:
    squeezed = f"regexp_replace(regexp_replace({c}, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g')"
    started = f"CASE WHEN regexp_matches({squeezed}, '^[A-Za-z]') THEN {squeezed} ELSE 'col_' || {squeezed} END"
    words = ", ".join(f"'{w}'" for w in sorted(naming.RESERVED))
    safe = f"(CASE WHEN upper({started}) IN ({words}) THEN {started} || '_col' ELSE {started} END)"
    return f"CASE WHEN length({safe}) > 30 THEN substr({safe}, 1, 25) || '_' || substr(md5({c}), 1, 4) ELSE {safe} END"


@query(f"SELECT name, {_sql_sanitize('name')} AS identifier FROM ({SQL_NAMES})")
def sanitize_identifiers(spark, d):
    return names_in_data(spark, d).select("name", name_columns.sanitized(F.col("name")).alias("identifier"))


@query(f"SELECT DISTINCT {_sql_sanitize("'catalogue column called ' || name")} AS identifier FROM ({SQL_NAMES})")
def long_identifier_hash(spark, d):
    long = F.concat(F.lit("catalogue column called "), F.col("name"))
    return names_in_data(spark, d).select(name_columns.sanitized(long).alias("identifier")).distinct()


@query(f"WITH p AS ({_sql_profile(SQL_INJECTED, 'orders', list(COLUMNS['orders']))}) SELECT column_name, null_ratio < 0.05 OR column_name = 'o_orderkey' AS not_null_compat, null_count = 0 OR column_name = 'o_orderkey' AS not_null FROM p")
def not_null_decision(spark, d):
    f = dependencies.measure(injected(spark, d), "orders")
    found = [(c, *[ddl.not_null(c, ("o_orderkey",), f.n_rows - f.non_null[c], f.n_rows, mode) for mode in ("compat", "textbook")]) for c in f.columns]
    return spark.createDataFrame(found, "column_name string, not_null_compat boolean, not_null boolean")


@query("SELECT 'start_time' AS column_name, CASE WHEN max(length(l_returnflag)) * 1.5 < 5 THEN 'VARCHAR2(5)' ELSE 'VARCHAR2(' || CAST(floor(max(length(l_returnflag)) * 1.5) AS INT) || ')' END AS oracle_type FROM lineitem")
def time_sizing(spark, d):
    types = profile.oracle_types(raw(spark, d, "lineitem").select(F.col("l_returnflag").alias("start_time")), "t").collect()
    return spark.createDataFrame([(r["column_name"], ddl.sized(r["column_name"], r["oracle_type"])) for r in types], "column_name string, oracle_type string")


_CREATED = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}


def _sql_create(t: str) -> str:
    columns = " UNION ALL ".join(f"SELECT {i} AS i, * FROM ({_sql_type(t, c, _kind(c))})" for i, c in enumerate(COLUMNS[t]))
    return f"SELECT '{t}' AS table_name, 'CREATE TABLE {t} (' || chr(10) || string_agg('    ' || {_sql_sanitize('column_name')} || ' ' || oracle_type || ' NOT NULL', ',' || chr(10) ORDER BY i) || ',' || chr(10) || '    CONSTRAINT pk_{t} PRIMARY KEY ({_CREATED[t]})' || chr(10) || ');' AS statement FROM ({columns})"


@query(" UNION ALL ".join(map(_sql_create, _CREATED)))
def ddl_tables(spark, d):
    out = []
    for t, key in _CREATED.items():
        df = raw(spark, d, t)
        f = dependencies.measure(df, t)
        types = {r["column_name"]: r["oracle_type"] for r in profile.oracle_types(df, t).collect()}
        out.append((t, ddl.create_table(t, [(c, types[c], ddl.not_null(c, (key,), f.n_rows - f.non_null[c], f.n_rows)) for c in f.columns], (key,))))
    return spark.createDataFrame(out, "table_name string, statement string")


#: The detected keys with their place i in the order of tables and columns.
_PLACES = ", ".join(f"('{t}', '{c}', {i})" for i, (t, c) in enumerate((t, c) for t in sorted(TABLES) for c in COLUMNS[t].values()))
_DETECTED = f"(SELECT k.*, row_number() OVER (ORDER BY place) AS i FROM ({ORACLE_SQL['foreign_keys_detected']}) k JOIN (VALUES {_PLACES}) p(t, c, place) ON p.t = fk_table AND p.c = fk_column)"


@query(f"SELECT 'ALTER TABLE ' || fk_table || chr(10) || '    ADD CONSTRAINT fk_' || fk_table || '_' || i || chr(10) || '    FOREIGN KEY (' || fk_column || ')' || chr(10) || '    REFERENCES ' || pk_table || '(' || pk_column || ');' AS statement FROM {_DETECTED}")
def fk_constraints_ddl(spark, d):
    found, facts = _detected(spark, d)
    made = ddl.foreign_key_constraints(found, {t: f.primary_key for t, f in facts.items()}, facts)
    return spark.createDataFrame([(s,) for s in made.statements], "statement string")


@query(f"SELECT 'CREATE INDEX idx_' || fk_table || '_' || i || ' ON ' || fk_table || '(' || fk_column || ');' AS statement FROM {_DETECTED}")
def index_ddl(spark, d):
    return spark.createDataFrame([(s,) for s in ddl.indexes(_detected(spark, d)[0])], "statement string")


@query(f"SELECT fk_table AS child, pk_table AS parent, fk_column || ' → ' || pk_column AS label FROM {_DETECTED}")
def erd_edges(spark, d):
    return spark.createDataFrame(erd.edges(_detected(spark, d)[0]), "child string, parent string, label string")
