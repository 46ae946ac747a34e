"""Minimal functional dependencies with determinants of several columns, level by level.

A determinant's partition is kept as hashed ids of its groups: a narrow column is its own id, a wide one has 128 bits,
and the product of partitions is the hash of their ids, so no rows have to be joined by number. A level holds the
determinants of one size. What is asked of one is pruned first: a dependent is out where part of the determinant
gives it already, and a determinant is out where one of its columns depends on others of them. The rest is refuted on
a bounded sample (a violation there is one in all rows), and what the sample can't refute is asked of all rows, a few
determinants for each job, each with all its dependents at once.

Nulls are values: two nulls are equal, and a null differs from every value.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relforge.functions.hashing import row_hash, wide_hash
from relforge.sources.catalog import ROW_ORDER, plain
from relforge.sources.scratch import saved

from .dependencies import _NARROW, DETERMINANTS_PER_JOB, MAX_DETERMINANT, Sample


@dataclass(frozen=True, order=True)
class Dependency:
    """determinant -> dependent; a column of one value depends on the empty determinant."""

    determinant: tuple[str, ...]
    dependent: str


def _holds_in_sample(sample: Sample, x: tuple[str, ...], ys: list[str]) -> list[str]:
    """The dependents without a violation in the sample: rows in the groups' order, where neighbours of one group
    have to agree."""
    n = len(next(iter(sample.columns.values())))
    groups = sample.groups(x) if x else np.zeros(n, np.int64)
    order = np.argsort(groups, kind="stable")
    same = groups[order][1:] == groups[order][:-1]
    return [y for y in ys if not (same & (sample.columns[y][order][1:] != sample.columns[y][order][:-1])).any()]


def _ids(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, list[Column]]]:
    """A written table of fixed-width ids, and for each column its parts there."""
    df = plain(df.drop(ROW_ORDER))
    made, parts = [], {}
    for i, c in enumerate(columns):
        q = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, _NARROW):
            made.append(q.alias(f"c{i}"))
            parts[c] = [F.col(f"c{i}")]
        else:
            made += [F.when(q.isNotNull(), row_hash([q], seed)).alias(f"c{i}_{seed}") for seed in (0, 1)]
            parts[c] = [F.col(f"c{i}_{seed}") for seed in (0, 1)]
    return saved(df.select(made), "ids"), parts


def _confirmed(ids: DataFrame, parts: dict[str, list[Column]], asked: list[tuple[tuple[str, ...], list[str]]]) -> set[tuple[tuple[str, ...], str]]:
    """Those of (determinant, dependents) that hold in all rows."""
    found = set()
    for at in range(0, len(asked), DETERMINANTS_PER_JOB):
        job = asked[at : at + DETERMINANTS_PER_JOB]
        out = None
        for k, (x, ys) in enumerate(job):
            keys = [p for c in x for p in parts[c]]
            group = [keys[0].alias("g0")] if len(keys) == 1 else wide_hash(keys) if keys else [F.lit(0).alias("g0")]
            values = ids.select(*group, *[p.alias(f"y{i}_{j}") for i, y in enumerate(ys) for j, p in enumerate(parts[y])])
            wide = [f"y{i}_{j}" for i, y in enumerate(ys) for j in range(len(parts[y]))]
            by = [c for c in values.columns if c in ("g0", "g1")]
            groups = values.groupBy(*by).agg(F.count("*").alias("n"), *[m(w).alias(f"{k2}_{w}") for w in wide for k2, m in (("lo", F.min), ("hi", F.max), ("k", F.count))])
            one = lambda w: ((F.col(f"lo_{w}") == F.col(f"hi_{w}")) & (F.col(f"k_{w}") == F.col("n"))) | (F.col(f"k_{w}") == 0)
            rows = F.array(*[F.struct(F.lit(i).alias("y"), _every([F.coalesce(F.bool_and(F.coalesce(one(w), F.lit(False))), F.lit(True)) for w in wide if w.startswith(f"y{i}_")]).alias("holds")) for i in range(len(ys))])
            part = groups.agg(rows.alias("r")).select(F.lit(k).alias("x"), F.explode("r").alias("r")).select("x", "r.y", "r.holds")
            out = part if out is None else out.unionByName(part)
        found |= {(job[r["x"]][0], job[r["x"]][1][r["y"]]) for r in out.where("holds").collect()}
    return found


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def minimal_dependencies(df: DataFrame, columns: list[str] | None = None, max_size: int = MAX_DETERMINANT) -> list[Dependency]:
    """All dependencies X -> y with up to max_size columns in X that hold in every row, and of which no part of X
    gives y. In a table of no row or one, every column depends on nothing."""
    columns = columns or [c for c in df.columns if c != ROW_ORDER]
    sample = Sample(df.select(*[F.col(f"`{c}`") for c in columns]))
    ids, parts = _ids(df, columns)
    found: dict[str, list[frozenset]] = {y: [] for y in columns}
    for size in range(max_size + 1):
        asked = []
        for x in combinations(columns, size):
            whole = frozenset(x)
            if any(d <= whole - {b} for b in x for d in found[b]):
                continue  # one of its columns depends on others of them: whatever x gives, they give
            open_ys = [y for y in columns if y not in whole and not any(d <= whole for d in found[y])]
            if open_ys and (left := _holds_in_sample(sample, x, open_ys)):
                asked.append((x, left))
        for x, y in _confirmed(ids, parts, asked):
            found[y].append(frozenset(x))
    place = {c: i for i, c in enumerate(columns)}
    return sorted(Dependency(tuple(sorted(x, key=place.get)), y) for y, xs in found.items() for x in xs)
