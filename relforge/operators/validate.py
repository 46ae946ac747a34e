"""Checks of a schema against its data: keys, references, lossless decomposition, normal-form hints."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relforge.functions import graphs
from relforge.functions.hashing import multiset_sums, wide_hash
from relforge.sources.catalog import ROW_ORDER, plain

from . import dependencies as deps
from .decompose import coverage
from .dependencies import TableFacts
from .foreign_keys import ForeignKey, inclusion

LEAST_COVERAGE = 0.9


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class Report:
    checks: dict[str, bool] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def is_valid(self) -> bool:
        return not self.errors


def key_violations(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """table_name, key, duplicates (key values that occur more than once), nulls (rows with a null in the key)."""
    out = None
    for t, key in sorted(keys.items()):
        has_null = F.lit(False)
        for c in key:
            has_null = has_null | _q(c).isNull()
        groups = tables[t].groupBy(*[_q(c) for c in key]).agg(F.count("*").alias("n")).withColumn("has_null", has_null)
        part = groups.agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("has_null"), F.col("n"))), F.lit(0)).alias("nulls"))
        part = part.select(F.lit(t).alias("table_name"), F.lit("+".join(key)).alias("key"), "duplicates", "nulls")
        out = part if out is None else out.unionByName(part)
    return out


def orphans(tables: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """fk_table, fk_column, pk_table, pk_column, n_values, n_missing, coverage."""
    found = inclusion(tables, [(k.fk_table, k.fk_column, k.pk_table, k.pk_column) for k in keys if not k.more])
    return found.withColumn("coverage", F.when(F.col("n_values") > 0, 1 - F.col("n_missing") / F.col("n_values")).otherwise(F.lit(1.0)))


def rejoin_difference(source: DataFrame, pieces: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """lost, added: rows of the source that joining its pieces does not give back, and rows that it makes up.

    pieces: the rest of the source first, then each extracted table with the columns it hangs on. A piece's
    missing match joins as null, and null keys match each other.
    """
    joined, _ = pieces[0]
    for piece, on in pieces[1:]:
        renamed = piece.select(*[_q(c).alias(f"_on_{c}" if c in on else c) for c in piece.columns])
        same = F.lit(True)
        for c in on:
            same = same & _q(c).eqNullSafe(F.col(f"_on_{c}"))
        joined = joined.join(renamed, same, "left").drop(*[f"_on_{c}" for c in on])
    return difference(source, joined)


def _signed(a: DataFrame, b: DataFrame) -> tuple[DataFrame, list[Column]]:
    columns = [c for c in a.columns if c != ROW_ORDER]
    pick = lambda df, sign: plain(df).select(*map(_q, columns), F.lit(sign).cast("long").alias("_sign"))
    return pick(a, 1).unionByName(pick(b, -1)), [_q(c) for c in columns]


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated ones as often, in any order: sums of row hashes in one
    aggregate, so no row moves."""
    both, columns = _signed(a, b)
    return not any(both.agg(F.sum("_sign").alias("n"), *multiset_sums(columns, F.col("_sign"))).na.fill(0).first())


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """lost, added: rows of a that b has not, and rows that b has beyond a, repeated rows counted each.

    The tables' fingerprints are compared first. Only if they differ are rows balanced, by 128-bit hashes.
    """
    if same_rows(a, b):
        return a.sparkSession.createDataFrame([(0, 0)], "lost long, added long")
    both, columns = _signed(a, b)
    balance = both.select(*wide_hash(columns), "_sign").groupBy("g0", "g1").agg(F.sum("_sign").alias("n"))
    over = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0))
    return balance.agg(over(F.col("n")).alias("lost"), over(-F.col("n")).alias("added"))


def address_hint(df: DataFrame, column: str, order: list[str], n: int = 10) -> DataFrame:
    """share (of the first n values that hold a comma), is_concatenated (more than half)."""
    s = df.where(_q(column).isNotNull()).orderBy(*map(_q, order)).limit(n).agg(F.avg(F.contains(_q(column), F.lit(",")).cast("int")).alias("share"))
    return s.withColumn("is_concatenated", F.coalesce(F.col("share") > 0.5, F.lit(False)))


def validate(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], foreign: list[ForeignKey], facts: dict[str, TableFacts] | None = None) -> Report:
    """All checks of a schema. A self-reference is no cycle; missing values count as an error below 90 % coverage
    and as a warning above. With the tables' facts their data is asked for dependencies on parts of a key and on other
    columns; what is found is a warning, as an extraction may have been declined for its small size."""
    report = Report()
    known = {t: k for t, k in keys.items() if k and t in tables and all(c in tables[t].columns for c in k)}
    for t in sorted(tables):
        if not keys.get(t):
            report.warnings.append(f"{t} has no primary key")
        elif t not in known:
            report.errors.append(f"{t}: key column missing: {', '.join(c for c in keys[t] if c not in tables[t].columns)}")
        elif any((k.fk_table, k.columns) == (t, keys[t]) and k.pk_table != t and k.reason != "split" for k in foreign):
            report.errors.append(f"{t}: its key is a foreign key")
    for r in key_violations(tables, known).collect() if known else []:
        if r["duplicates"]:
            report.errors.append(f"{r['table_name']}: {r['duplicates']} duplicate values of {r['key']}")
        if r["nulls"]:
            report.errors.append(f"{r['table_name']}: {r['nulls']} rows with a null in {r['key']}")
    report.checks["primary_keys"] = not report.errors
    before = len(report.errors)
    edges: list[tuple[str, str]] = []
    there = []
    for k in foreign:
        if graphs.closes_cycle(edges, k.fk_table, k.pk_table, allow_self=True):
            report.errors.append(f"{k.fk_table} -> {k.pk_table} closes a cycle")
        edges.append((k.fk_table, k.pk_table))
        gone = [f"{t}.{c}" for t, c in (*((k.fk_table, c) for c in k.columns), *((k.pk_table, c) for c in k.targets)) if t not in tables or c not in tables[t].columns]
        if gone:
            report.errors.append(f"column missing: {', '.join(gone)}")
        else:
            there.append(k)
    report.checks["lossless_join"] = len(there) == len(foreign)
    several = [k for k in there if k.more]
    for r in coverage(tables, several).where("n_missing > 0").collect() if several else []:
        where = report.errors if r["coverage"] < LEAST_COVERAGE else report.warnings
        where.append(f"{r['child']}.{r['columns']}: {r['n_missing']} of {r['n_values']} values are not in {r['parent']}")
    for r in orphans(tables, there).collect() if len(several) < len(there) else []:
        if r["n_missing"]:
            where = report.errors if r["coverage"] < LEAST_COVERAGE else report.warnings
            where.append(f"{r['fk_table']}.{r['fk_column']}: {r['n_missing']} of {r['n_values']} values are not in {r['pk_table']}.{r['pk_column']}")
    report.checks["foreign_keys"] = len(report.errors) == before
    for t, df in sorted(tables.items()):
        for c in df.columns:
            if c.lower() == "address" and address_hint(df, c, [c]).first()["is_concatenated"]:
                report.warnings.append(f"{t}.{c} looks concatenated")
    if facts is not None:
        left = []
        for t in sorted(known):
            f = replace(facts[t], primary_key=known[t])
            left += [f"{t}: {c} depends on {'+'.join(part)} alone" for part, found in deps.partial_dependencies(tables[t], f.primary_key, f.columns).items() for c in found]
            left += [f"{t}: {', '.join(found)} depends on {middle}" for _, middle, found in deps.transitive_dependencies(tables[t], f)]
        report.checks["third_normal_form"] = not left
        report.warnings += left
    return report


def sql_script_problems(script: str) -> list[str]:
    """What a DDL script lacks."""
    return [f"no {word}" for word in ("CREATE TABLE", "PRIMARY KEY", ";", "COMMIT") if word not in script]
