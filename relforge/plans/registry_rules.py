"""Queries over the rules, decompositions, checks, scripts and the workflow, with their DuckDB counterparts."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.functions import graphs, name_columns, naming
from relforge.operators import dependencies, foreign_keys, normalize, profile, validate
from relforge.operators.dependencies import TableFacts
from relforge.operators.foreign_keys import ForeignKey
from relforge.sources.catalog import Catalog, UnsupportedSource, export
from relforge.sources.scratch import shared_dir

from . import ddl, erd, workflow
from .registry import _DETECTED, _MIDDLE, _SQL_COUNTS, COLUMNS, FLAT, FOREIGN, KEYS, SQL_FLAT, SQL_NAMES, SQL_ORDERS_FLAT, TABLES, _any, _canonicals, _detected, _kind, _sql_ratio, _sql_type, canonical, flat, names_in_data, orders_facts, orders_flat, query, raw, sql_canonical


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _text(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """Fixed expectations as SQL."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns})"


ALL = [(t, c) for t in TABLES for c in COLUMNS[t].values()]
_HIGH, _WORD = "_id|_key|_code|_ref|_number|sys_id|uuid|guid", "(^|[^a-z0-9])(id|key|code|ref|number)([^a-z0-9]|$)"


# Names


@query(f"""SELECT name, CASE WHEN regexp_matches(lower(name), '{_HIGH}') THEN 'high' WHEN regexp_matches(lower(name), '{_WORD}') THEN 'moderate' ELSE '' END AS textbook,
CASE WHEN regexp_matches(lower(name), '{_HIGH}') THEN 'high' WHEN regexp_matches(lower(name), '{_WORD}') OR regexp_matches(lower(name), '^(id|key|code|ref|number)|(id|key|code|ref|number)$') THEN 'moderate' ELSE '' END AS compat
FROM ({SQL_NAMES})""")
def identity_semantics(spark, d):
    strength = lambda mode: name_columns.identity_strength(F.col("name"), mode).alias(mode)
    return names_in_data(spark, d).select("name", strength("textbook"), strength("compat"))


@query(f"SELECT name, NOT ends_with(lower(name), '_id') AND regexp_matches(lower(name), '{_any(naming.BUSINESS_WORDS)}') AS is_business FROM ({SQL_NAMES})")
def business_columns(spark, d):
    return names_in_data(spark, d).select("name", name_columns.business_name(F.col("name")).alias("is_business"))


@query(f"SELECT name, regexp_matches(lower(name), '{_any(naming.CHILD_SUFFIXES)}') AS is_child FROM ({SQL_NAMES})")
def child_tables(spark, d):
    return names_in_data(spark, d).select("name", name_columns.is_child_table(F.col("name")).alias("is_child"))


@query(f"SELECT name AS word, upper(name) IN ({', '.join(f"'{w}'" for w in sorted(naming.RESERVED))}) AS is_reserved FROM ({SQL_NAMES})")
def reserved_words(spark, d):
    return names_in_data(spark, d).select(F.col("name").alias("word"), name_columns.is_reserved(F.col("name")).alias("is_reserved"))


def _sql_family(kind: str) -> str:
    return f"CASE WHEN {kind} LIKE '%NUMBER%' OR {kind} LIKE '%INT%' THEN 'number' WHEN {kind} LIKE '%CHAR%' THEN 'text' WHEN {kind} LIKE '%DATE%' OR {kind} LIKE '%TIMESTAMP%' THEN 'time' ELSE {kind} END"


_TYPED = " UNION ALL ".join(_sql_type(t, c, _kind(c)) for t in ("orders", "nation", "events") for c in COLUMNS[t])


@query(f"WITH t AS ({_TYPED}) SELECT a.table_name || '.' || a.column_name AS a, b.table_name || '.' || b.column_name AS b, {_sql_family('a.oracle_type')} = {_sql_family('b.oracle_type')} AS compatible FROM t a, t b WHERE a.table_name = 'orders'")
def type_families(spark, d):
    """Whether the columns of the orders go with those of other tables, by the types that their data have."""
    found = [(t, r["column_name"], r["oracle_type"]) for t in ("orders", "nation", "events") for r in profile.oracle_types(raw(spark, d, t), t).collect()]
    return _rows(spark, [(f"{t}.{c}", f"{u}.{e}", foreign_keys.compatible(x, y)) for t, c, x in found if t == "orders" for u, e, y in found], "a string, b string, compatible boolean")


@query(f"WITH RECURSIVE e AS (SELECT fk_table AS a, pk_table AS b FROM {_DETECTED}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), t AS (" + values("t", [(t,) for t in TABLES]) + """)
SELECT x.t AS child, y.t AS parent, x.t = y.t OR EXISTS (SELECT 1 FROM r WHERE r.a = y.t AND r.b = x.t) AS closes, x.t <> y.t AND EXISTS (SELECT 1 FROM r WHERE r.a = y.t AND r.b = x.t) AS closes_if_self_is_allowed FROM t x, t y""")
def cycles_of_new_edges(spark, d):
    """Which references would close a cycle with those that the data show."""
    edges = sorted({(k.fk_table, k.pk_table) for k in _detected(spark, d)[0]})
    return _rows(spark, [(a, b, graphs.closes_cycle(edges, a, b), graphs.closes_cycle(edges, a, b, allow_self=True)) for a in TABLES for b in TABLES], "child string, parent string, closes boolean, closes_if_self_is_allowed boolean")


# Keys


def _sql_suitable() -> str:
    """table_name, column_name, pos, strength, suitable and score of every canonical column."""
    columns = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS pos, count(*) AS n, count(DISTINCT {c}) AS u, count({c}) AS k FROM ({sql_canonical(t)})" for i, (t, c) in enumerate(ALL))
    black = _any(naming.PRIMARY_KEY_BLACKLIST)
    return f"""SELECT *, strength <> '' AND NOT (strength = 'moderate' AND regexp_matches(column_name, '{black}')) AND n > 0 AND u = n AND k = n AS suitable,
100 + CASE WHEN strength = 'high' THEN 20 ELSE 10 END - CASE WHEN length(column_name) > 20 THEN 5 ELSE 0 END + CASE WHEN ends_with(column_name, '_id') THEN 15 WHEN regexp_matches(column_name, '(_key|_code)$') THEN 10 ELSE 0 END AS score
FROM (SELECT *, CASE WHEN regexp_matches(column_name, '{_HIGH}') THEN 'high' WHEN regexp_matches(column_name, '{_WORD}') THEN 'moderate' ELSE '' END AS strength FROM ({columns}))"""


def _measured(spark, d) -> dict[str, TableFacts]:
    return dependencies.measure_all(_canonicals(spark, d))


@query(f"SELECT table_name, column_name, suitable FROM ({_sql_suitable()})")
def key_suitability(spark, d):
    return _rows(spark, [(t, c, normalize.suitable(c, f)) for t, f in _measured(spark, d).items() for c in f.columns], "table_name string, column_name string, suitable boolean")


_REFERENCES = values("table_name, column_name", [(t, c) for t, c, _, _ in FOREIGN])


@query(f"""WITH s AS ({_sql_suitable()}), r AS (SELECT table_name, column_name, true AS ref FROM ({_REFERENCES}))
SELECT table_name, column_name, (coalesce(ref, false) OR (ends_with(column_name, '_id') AND column_name <> table_name || '_id')) AND u + CAST(k < n AS INT) < n AS repeats, coalesce(ref, false) AS is_reference FROM s LEFT JOIN r USING (table_name, column_name)""")
def repeating_foreign_keys(spark, d):
    known = [ForeignKey(*k) for k in FOREIGN]
    return _rows(spark, [(t, c, normalize.repeating_foreign_key(t, c, f, known), ddl.references(t, c, known)) for t, f in _measured(spark, d).items() for c in f.columns], "table_name string, column_name string, repeats boolean, is_reference boolean")


@query(f"""WITH s AS ({_sql_suitable()}), best AS (SELECT table_name, column_name, score FROM s WHERE suitable AND (table_name, column_name) NOT IN ({_REFERENCES}) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY score DESC, pos) = 1)
SELECT t.table_name, coalesce(column_name, t.table_name || '_id') AS key, column_name IS NULL AS is_surrogate, coalesce(score, 0) AS score FROM (SELECT DISTINCT table_name FROM s) t LEFT JOIN best USING (table_name)""")
def best_keys(spark, d):
    known = [ForeignKey(*k) for k in FOREIGN]
    found = [(t, normalize.choose_key(t, f, known)) for t, f in _measured(spark, d).items()]
    return _rows(spark, [(t, "+".join(k.columns), k.surrogate, k.score) for t, k in found], "table_name string, key string, is_surrogate boolean, score long")


@query(f"""WITH s AS ({_sql_suitable()}), k AS (SELECT table_name, arg_min(column_name, pos) AS key FROM s WHERE u = n AND k = n AND n > 0 AND ends_with(column_name, '_id') AND (table_name, column_name) NOT IN ({_REFERENCES}) GROUP BY table_name)
SELECT t.table_name, coalesce(key, '') AS key FROM (SELECT DISTINCT table_name FROM s) t LEFT JOIN k USING (table_name)""")
def ddl_keys(spark, d):
    """Keys of tables without a mined one: none is given that is not unique."""
    known = [ForeignKey(*k) for k in FOREIGN]
    return _rows(spark, [(t, "+".join(ddl.pick_key(t, f, known))) for t, f in _measured(spark, d).items()], "table_name string, key string")


#: Case, columns of a table and their new names, the mined key, references, and SQL of the key that the rules give.
_CASES = [
    ("associative", "lineitem", {"l_partkey": "part_id", "l_suppkey": "supp_id"}, ("part_id", "supp_id"), ["part_id", "supp_id"], "SELECT 'part_id+supp_id' FROM part LIMIT 1"),
    ("business", "customer", {"c_name": "name", "c_custkey": "customer_id"}, ("name",), [], "SELECT CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 'customer_id' ELSE 'name' END FROM customer"),
    ("suffix", "part", {"p_brand": "label", "p_partkey": "part_code"}, (), [], "SELECT CASE WHEN count(*) = count(DISTINCT p_partkey) THEN 'part_code' ELSE '' END FROM part"),
    ("reference", "orders", {"o_orderkey": "order_id", "o_custkey": "customer_id"}, ("order_id",), ["order_id"], "SELECT 'order_id' FROM orders LIMIT 1"),
    ("none", "lineitem", {"l_orderkey": "up_id", "l_quantity": "label"}, (), ["up_id"], "SELECT CASE WHEN count(*) = count(DISTINCT l_quantity) THEN 'label' ELSE '' END FROM lineitem"),
]


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, ({sql}) AS key" for name, _, _, _, _, sql in _CASES))
def ddl_key_rules(spark, d):
    """The rules for keys on tables of the data: two references, a business name, an ending, a reference, no unique column."""
    out = []
    for name, t, columns, key, refs, _ in _CASES:
        df = raw(spark, d, t).select(*[F.col(a).alias(b) for a, b in columns.items()]).distinct()
        f = dependencies.measure(df, name)
        f.primary_key, f.candidate_keys = key, [key] if key else []
        out.append((name, "+".join(ddl.pick_key(name, f, [ForeignKey(name, c, "other", c) for c in refs]))))
    return _rows(spark, out, "name string, key string")


#: Parents by their key, and the order lines' columns that a child has: which references have a valid target.
_PARENTS = [("orders", "o_orderkey", "order_id"), ("lineitem", "l_orderkey", "order_id"), ("nation", "n_regionkey", "region_id"), ("customer", "c_custkey", "customer_id")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS parent, '{n}' AS column_name, count(*) = count(DISTINCT {c}) AS is_target, {str(n == 'order_id').lower()} AS holds_all FROM {t}" for t, c, n in _PARENTS))
def reference_targets(spark, d):
    """Whether a column may be referred to (it is unique), and whether a child of it holds the whole key (column, line)."""
    out = []
    for t, _, n in _PARENTS:
        f = dependencies.measure(canonical(spark, d, t), t)
        f.candidate_keys = [(c,) for c in f.columns if f.is_unique(c)]
        out.append((t, n, ddl.valid_target(ForeignKey("child", n, t, n), {}, {t: f}), ddl.composite_target(["order_id", "line_number"], (n, "line_number"))))
    return _rows(spark, out, "parent string, column_name string, is_target boolean, holds_all boolean")


@query(f"SELECT count(*) AS statements, 'events.event_id: a table is missing; lineitem.order_id: the key of lines is order_id, line_number and events does not hold all of it; region.region_id: closes a cycle' AS skipped FROM {_DETECTED}".replace("lineitem.order_id: the", "events.user_id: the"))
def constraints_that_are_skipped(spark, d):
    """The detected references as constraints, and what is left out of more that can't be: a table that is missing, a part
    of a composite key, a cycle."""
    found, facts = _detected(spark, d)
    facts = facts | {"lines": replace(facts["lineitem"], primary_key=("order_id", "line_number"), candidate_keys=[("order_id", "line_number")])}
    more = [ForeignKey("events", "event_id", "gone", "id"), ForeignKey("events", "user_id", "lines", "order_id"), ForeignKey("region", "region_id", "nation", "nation_id")]
    made = ddl.foreign_key_constraints([*found, *more], {t: f.primary_key for t, f in facts.items()}, facts)
    return _rows(spark, [(len(made.statements), "; ".join(made.skipped))], "statements long, skipped string")


# Normal forms


@query(f"WITH src AS ({SQL_ORDERS_FLAT}), m AS ({' UNION ALL '.join(_sql_ratio((x,), y, f'WHERE {x} IS NOT NULL') for x in FLAT if x != 'line_number' for y in _MIDDLE if x != y)}), o AS ({values('c, pos', [(c, i) for i, c in enumerate(_MIDDLE)])}) SELECT dependent AS attribute, CASE WHEN bool_or(determinant = 'order_id' AND ratio = 1) THEN 'key' END AS place, min_by(determinant, pos) FILTER (determinant <> 'order_id' AND ratio = 1) AS other FROM m LEFT JOIN o ON c = determinant GROUP BY dependent")
def attribute_placement(spark, d):
    df = orders_flat(spark, d)
    columns = [c for c in FLAT if c != "line_number"]
    return _rows(spark, [(c, normalize.placement(df, ("order_id",), c, columns), normalize.placement(df, ("order_status",), c, [x for x in columns if x not in ("order_id", "order_status")] + (["order_status"] if c != "order_status" else []))) for c in _MIDDLE], "attribute string, place string, other string")


_CHAINS = [("customer_id", ["customer_name", "nation_id"]), ("nation_id", ["nation_name"]), ("order_status", ["nation_name"]), ("market_segment", ["customer_id"])]


@query(f"WITH src AS ({SQL_ORDERS_FLAT}), {_SQL_COUNTS}, m AS ({' UNION ALL '.join(_sql_ratio((a,), t) for a, ts in _CHAINS for t in ts)}) SELECT determinant AS middle, bool_or(ratio = 1) AND (any_value(u) < 0.9 * any_value(n) OR any_value(u) < any_value(n)) AS holds FROM m JOIN u USING (determinant) GROUP BY determinant")
def dependency_chains(spark, d):
    df = orders_flat(spark, d)
    facts = orders_facts(df)
    return _rows(spark, [(a, normalize.chain_holds(df, ("order_id",), a, ts, facts)) for a, ts in _CHAINS], "middle string, holds boolean")


def _shapes(spark, tables: dict[str, DataFrame]) -> DataFrame:
    return _rows(spark, [(t, "+".join(df.columns), df.count()) for t, df in tables.items()], "table_name string, columns string, n_rows long")


@query("SELECT 'pages' AS table_name, 'page_id+html' AS columns, count(*) AS n_rows FROM pages UNION ALL SELECT 'pages_url', 'page_id+url_value', count(*) FROM (SELECT page_id, unnest(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '')) FROM pages)")
def first_normal_form_pages(spark, d):
    return _shapes(spark, normalize.first_normal_form("pages", raw(spark, d, "pages").select("page_id", "url", "html"), ["page_id"], ["url"], ["page_id"]))


@query(f"""WITH src AS ({SQL_ORDERS_FLAT}), n AS (SELECT count(*) AS n, count(DISTINCT customer_id) AS c FROM src)
SELECT 'flat' AS table_name, 'order_id+customer_id+order_status' AS columns, n AS n_rows FROM n UNION ALL SELECT 'customer', 'customer_id+customer_name+market_segment+nation_id', c FROM n""")
def third_normal_form_orders(spark, d):
    df = orders_flat(spark, d).select("order_id", "customer_id", "order_status", "customer_name", "market_segment", "nation_id")
    facts = orders_facts(df)
    facts.transitive = [(("order_id",), "customer_id", ["customer_name", "market_segment", "nation_id"])]
    return _shapes(spark, normalize.third_normal_form("flat", df, facts))


@query(f"WITH src AS ({SQL_FLAT}) " + " UNION ALL ".join(f"SELECT '{c}' AS lost, count({c}) AS n_values FROM src" for c in FLAT if c not in ("order_id", "line_number")))
def attribute_preservation(spark, d):
    """Columns that no table holds if the flat lines keep only the rest of their second normal form, with their values."""
    df = flat(spark, d)
    pieces = normalize.second_normal_form("flat", df, {("order_id",): [c for c in FLAT if c not in ("order_id", "line_number")]})
    lost = normalize.missing_columns(df.columns, {"flat": pieces["flat"].columns})
    whole = normalize.missing_columns(df.columns, {t: p.columns for t, p in pieces.items()})
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in lost]).first()
    return _rows(spark, [(c, counts[c]) for c in lost if c not in whole], "lost string, n_values long")


@query("SELECT 'region' AS table_name, 'region_id' AS key, count(*) AS n_rows, CAST(count(DISTINCT r_regionkey) AS BIGINT) AS n_keys FROM region UNION ALL SELECT 'nation', 'nation_id', count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'tags', 'tags_id', (SELECT count(*) FROM region), (SELECT count(*) FROM region) UNION ALL SELECT 'tags_words', 'tags_words_id', 2 * (SELECT count(*) FROM region), 2 * (SELECT count(*) FROM region)")
def normalized_tables(spark, d):
    tables = {t: canonical(spark, d, t) for t in ("region", "nation")}
    tables["tags"] = raw(spark, d, "region").select(F.concat_ws(",", "r_name", F.lit("x")).alias("words"))
    facts = {t: dependencies.profile_table(df, t) for t, df in tables.items()}
    found = normalize.normalize(tables, facts, [ForeignKey("nation", "region_id", "region", "region_id")])
    out = []
    for t, df in found.tables.items():
        key = found.keys[t]
        out.append((t, "+".join(key), df.count(), df.select(*key).distinct().count()))
    return _rows(spark, out, "table_name string, key string, n_rows long, n_keys long")


@query("SELECT 'nation' AS fk_table, 'region_id' AS fk_column, 'region' AS pk_table UNION ALL SELECT 'customer', 'nation_id', 'nation' UNION ALL SELECT 'orders', 'customer_id', 'customer' UNION ALL SELECT 'supplier', 'nation_id', 'nation' UNION ALL SELECT 'lineitem', 'part_id', 'part'")
def foreign_keys_by_name(spark, d):
    found = foreign_keys.infer_by_name(_canonicals(spark, d), {t: (k,) for t, k in KEYS.items()}, [ForeignKey("lineitem", "order_id", "orders", "order_id")])
    return _rows(spark, [(k.fk_table, k.fk_column, k.pk_table) for k in found], "fk_table string, fk_column string, pk_table string")


# Checks


@query("""SELECT true AS primary_keys, true AS foreign_keys, true AS lossless_join, 0 AS errors, (SELECT count(*) FROM (SELECT 1 FROM lineitem LIMIT 1)) AS tables_without_key""")
def schema_checks(spark, d):
    tables = _canonicals(spark, d)
    report = validate.validate(tables, {t: (k,) for t, k in KEYS.items()}, [ForeignKey(*k) for k in FOREIGN])
    return _rows(spark, [(report.checks["primary_keys"], report.checks["foreign_keys"], report.checks["lossless_join"], len(report.errors), sum("no primary key" in w for w in report.warnings))], "primary_keys boolean, foreign_keys boolean, lossless_join boolean, errors long, tables_without_key long")


@query("SELECT 'nation.region_id: 1 of 5 values are not in region.region_id' AS message, 'error' AS level UNION ALL SELECT 'orders: ' || count(*) || ' duplicate values of o_custkey', 'error' FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'nation has no primary key', 'warning'")
def schema_errors(spark, d):
    tables = {"nation": canonical(spark, d, "nation"), "region": canonical(spark, d, "region").where("region_id > 0"), "orders": raw(spark, d, "orders")}
    report = validate.validate(tables, {"region": ("region_id",), "orders": ("o_custkey",)}, [ForeignKey("nation", "region_id", "region", "region_id")])
    return _rows(spark, [(m, "error") for m in report.errors] + [(m, "warning") for m in report.warnings], "message string, level string")


@query("SELECT script, problems FROM (SELECT count(*) AS n FROM nation), " + "(" + values("script, problems", [("full", ""), ("empty", "no CREATE TABLE, no PRIMARY KEY, no ;, no COMMIT"), ("uncommitted", "no COMMIT")]) + ") WHERE n > 0")
def script_checks(spark, d):
    full = _two_script(spark, d)
    scripts = {"full": full, "empty": "", "uncommitted": full.replace("COMMIT;\n", "")}
    return _rows(spark, [(n, ", ".join(validate.sql_script_problems(x))) for n, x in scripts.items()], "script string, problems string")


# Profiles, summaries, scripts and diagrams


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(COLUMNS[t])} AS n_columns FROM {t}" for t in TABLES))
def table_profiles(spark, d):
    return _rows(spark, [(t, f.n_rows, len(f.columns)) for t, f in _measured(spark, d).items()], "table_name string, n_rows long, n_columns long")


@query(values("column_name, oracle_type", [("day", "DATE"), ("slash", "DATE"), ("stamp", "DATE"), ("clock", "DATE"), ("mixed", "VARCHAR2(15)"), ("digits", "VARCHAR2(12)")]))
def date_texts(spark, d):
    ts = F.col("ts")
    df = raw(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "MM/dd/yyyy").alias("slash"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.date_format(ts, "HH:mm").alias("clock"), F.when(F.col("event_id") == 0, "never").otherwise(F.date_format(ts, "yyyy-MM-dd")).alias("mixed"), F.date_format(ts, "yyyyMMdd").alias("digits"))
    return profile.oracle_types(df, "events", ["event_id"]).where("column_name <> 'event_id'").select("column_name", "oracle_type")


@query(f"""WITH c AS (SELECT 'customer' AS table_name, 'customer_id' AS primary_key, count(*) AS n FROM customer UNION ALL SELECT 'nation', 'nation_id', count(*) FROM nation) SELECT table_name, primary_key, n AS n_rows, false AS violates_2nf FROM c""")
def profiled_tables(spark, d):
    found = {t: dependencies.profile_table(canonical(spark, d, t), t) for t in ("customer", "nation")}
    return _rows(spark, [(t, "+".join(f.primary_key), f.n_rows, f.violates_2nf) for t, f in found.items()], "table_name string, primary_key string, n_rows long, violates_2nf boolean")


@query("""SELECT 'profiles' AS name, '2 tables' || chr(10) || 'nation: 3 columns, ' || count(*) || ' rows, 2 nearly unique, 0 with nulls' || chr(10) || 'region: 2 columns, ' || (SELECT count(*) FROM region) || ' rows, 2 nearly unique, 0 with nulls' AS summary FROM nation
UNION ALL SELECT 'keys', 'nation: ' || count(*) || ' rows, key nation_id, 1 candidates, 3 dependencies, 2NF holds, 3NF holds' FROM nation
UNION ALL SELECT 'foreign keys', '1 foreign keys' || chr(10) || 'nation.region_id -> region.region_id (many-to-one, only parent)'
UNION ALL SELECT 'normalised', '1 tables' || chr(10) || 'nation (from nation): 3 columns, key nation_id'""")
def summaries(spark, d):
    tables = {t: canonical(spark, d, t) for t in ("nation", "region")}
    f = TableFacts("nation", ["nation_id", "nation_name", "region_id"], tables["nation"].count(), {}, {}, [("nation_id",)], ("nation_id",), {"nation_id": ["nation_name", "region_id"], "nation_name": ["nation_id"]})
    made = normalize.Normalized({"nation": tables["nation"]}, {"nation": ("nation_id",)}, {"nation": "nation"}, [])
    out = [("profiles", profile.summary(profile.profile_all(tables).collect())), ("keys", dependencies.summary({"nation": f})), ("foreign keys", foreign_keys.summary([ForeignKey("nation", "region_id", "region", "region_id", reason="only parent")])), ("normalised", normalize.summary(made))]
    return _rows(spark, out, "name string, summary string")


_TWO = {"nation": ["nation_id", "nation_name", "region_id"], "region": ["region_id", "region_name"]}

def _two(spark, d) -> tuple[dict[str, DataFrame], dict[str, TableFacts], list[ForeignKey]]:
    """Nations and regions with their measured keys and the references found between them."""
    tables = {t: canonical(spark, d, t) for t in _TWO}
    facts = dependencies.measure_all(tables)
    for t, f in facts.items():
        f.candidate_keys = dependencies.candidate_keys(tables[t], f)
        f.primary_key = f.candidate_keys[0]
    return tables, facts, foreign_keys.detect(tables, facts)


def _two_script(spark, d) -> str:
    tables, facts, found = _two(spark, d)
    types = {(t, r["column_name"]): r["oracle_type"] for t, df in tables.items() for r in profile.oracle_types(df, t).collect()}
    return ddl.script(facts, types, {t: f.primary_key for t, f in facts.items()}, found)


def _sql_table(t: str) -> str:
    names = {b: a for a, b in COLUMNS[t].items()}
    columns = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS name, * FROM ({_sql_type(t, names[c], _kind(names[c]))})" for i, c in enumerate(_TWO[t]))
    return f"SELECT 'CREATE TABLE {t} (' || chr(10) || string_agg('    ' || name || ' ' || oracle_type || ' NOT NULL', ',' || chr(10) ORDER BY i) || ',' || chr(10) || '    CONSTRAINT pk_{t} PRIMARY KEY ({_TWO[t][0]})' || chr(10) || ');' FROM ({columns})"


_LINKED = "(SELECT count(*) FILTER (n_regionkey IS NOT NULL AND n_regionkey NOT IN (SELECT r_regionkey FROM region)) = 0 AND count(n_regionkey) > 0 AND count(*) >= (SELECT count(*) FROM region) FROM nation)"


@query(f"""SELECT i, part FROM (VALUES (0, '-- Schema in third normal form'), (1, '-- DROP TABLE nation CASCADE CONSTRAINTS;'), (2, '-- DROP TABLE region CASCADE CONSTRAINTS;'), (3, ({_sql_table('region')})), (4, ({_sql_table('nation')})),
(5, 'ALTER TABLE nation' || chr(10) || '    ADD CONSTRAINT fk_nation_1' || chr(10) || '    FOREIGN KEY (region_id)' || chr(10) || '    REFERENCES region(region_id);'), (6, 'CREATE INDEX idx_nation_1 ON nation(region_id);'), (7, 'COMMIT;' || chr(10))) v(i, part) WHERE {_LINKED}""")
def schema_script(spark, d):
    """The script of two tables, from the types, nulls, keys and references that their data show."""
    return _rows(spark, list(enumerate(_two_script(spark, d).split("\n\n"))), "i long, part string")


@query("SELECT * FROM (" + values("kind, i, line", [("dot", i, x) for i, x in enumerate(["digraph schema {", "    rankdir=TB;", "    node [shape=record];", '    "nation" [label="{nation|* nation_id\\l  nation_name\\l  region_id\\l}"];', '    "region" [label="{region|* region_id\\l  region_name\\l}"];', '    "nation" -> "region" [label="region_id → region_id"];', "}"])]
+ [("mermaid", i, x) for i, x in enumerate(["erDiagram", "    nation {", "        int nation_id PK", "        string nation_name", "        int region_id FK", "    }", "    region {", "        int region_id PK", "        string region_name", "    }", "    region ||--o{ nation : region_id"])]) + f") WHERE {_LINKED}")
def diagrams(spark, d):
    """Diagrams of two tables with the keys and references that their data show."""
    tables, facts, found = _two(spark, d)
    keys = {t: f.primary_key for t, f in facts.items()}
    dot = erd.dot({t: df.columns for t, df in tables.items()}, keys, found)
    mermaid = erd.mermaid({t: [(c, erd.simple_type(k)) for c, k in df.dtypes] for t, df in tables.items()}, keys, found)
    return _rows(spark, [(k, i, x) for k, lines in (("dot", dot), ("mermaid", mermaid)) for i, x in enumerate(lines.splitlines())], "kind string, i long, line string")


# Sources and the workflow


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/relforge-files-{uuid.uuid4().hex}"


@query("SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('parquet')) k(kind)")
def written_and_read_back(spark, d):
    out, folder = None, _folder(spark)
    for kind in ("csv", "json", "parquet"):
        export({"nation": raw(spark, d, "nation")}, f"{folder}/{kind}", (kind,))
        found = Catalog.from_folder(spark, f"{folder}/{kind}")
        part = found.tables["nation"].select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey")
        out = part if out is None else out.unionByName(part)
    return out


@query(values("name, outcome", [("nation.csv", "read"), ("broken.json", "skipped"), ("notes.txt", "no reader")]))
def files_that_cannot_be_read(spark, d):
    folder = _folder(spark)
    export({"nation": raw(spark, d, "nation")}, folder, ("csv",))
    spark.createDataFrame([("{no json",)], "value string").coalesce(1).write.text(f"{folder}/broken.json")
    found = Catalog.from_folder(spark, folder)
    out = [(f"{t}.csv", "read") for t in found.tables] + [(n, "skipped") for n in found.skipped]
    try:
        Catalog.from_file(spark, f"{folder}/notes.txt")
    except UnsupportedSource:
        out.append(("notes.txt", "no reader"))
    return _rows(spark, out, "name string, outcome string")


@query(f"""SELECT 'status' AS what, 'completed' AS value UNION ALL SELECT 'valid', 'true' UNION ALL SELECT 'foreign key', 'nation.region_id -> region.region_id'
UNION ALL SELECT 'table', 'nation: ' || count(*) || ' rows, key nation_id' FROM nation UNION ALL SELECT 'table', 'region: ' || count(*) || ' rows, key region_id' FROM region
UNION ALL SELECT 'file', f FROM (VALUES ('nation.csv'), ('nation.json'), ('region.csv'), ('region.json')) v(f) UNION ALL SELECT 'script', 'ends with COMMIT'""")
def whole_workflow(spark, d):
    """All steps from a folder of CSV files to the schema, its script and diagrams, and the exported tables."""
    folder = _folder(spark)
    export({t: canonical(spark, d, t) for t in _TWO}, f"{folder}/in", ("csv",))
    state = workflow.run(spark, f"{folder}/in")
    out = [("status", state.status), *[("error", e) for e in state.errors]]
    if state.normalized:
        found = state.normalized
        out += [("foreign key", f"{k.fk_table}.{k.fk_column} -> {k.pk_table}.{k.pk_column}") for k in found.foreign_keys]
        out += [("table", f"{t}: {state.final_facts[t].n_rows} rows, key {'+'.join(found.keys[t])}") for t in sorted(found.tables)]
        export(found.tables, f"{folder}/out")
        from relforge.sources.catalog import names_in

        out += [("file", n) for n in names_in(spark, f"{folder}/out")]
    if state.report:
        out.append(("valid", str(state.report.is_valid).lower()))
    if state.script:
        out.append(("script", "ends with COMMIT" if state.script.endswith("COMMIT;\n") else "open"))
    return _rows(spark, out, "what string, value string")
