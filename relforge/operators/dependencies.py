"""Functional dependencies, unique column sets, candidate keys, partial and transitive dependencies.

A dependency X -> y is tested by grouping by X and asking whether the least and the largest y of a group agree,
which is the same as one distinct value but needs no distinct aggregate. Texts and other wide values are compared by
a 64-bit hash, so groups keep two numbers for each column. One union of such branches tests all determinants against
all columns at once. Rules that only ask whether a dependency or a key holds first try to refute it on a bounded
sample of rows, which is safe: a violation in some rows is one in all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from relforge.functions import naming
from relforge.functions.hashing import row_hash, wide_hash
from relforge.sources.catalog import ROW_ORDER, plain
from relforge.sources.scratch import saved

THRESHOLD = 0.99
MAX_DETERMINANT = 3
#: Determinants that are tested in one job; each is a shuffle of its own.
DETERMINANTS_PER_JOB = 8
#: Column sets that are looked at for duplicates in one scan; each row is hashed once for each of them.
SETS_PER_SCAN = 100
#: One value in so many of a set's leading column, by its hash, is looked at before all others.
FIRST_LOOKS = (1024, 32)
#: Hashes that a task sends, and that a task compares; both stay in memory.
HASHES_PER_TASK, HASHES_IN_A_TASK = 8_000_000, 1_000_000
#: Rows in which dependencies and keys are refuted before all rows are asked.
REFUTING_ROWS = 100_000
_NARROW = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def ratios(df: DataFrame, determinants: list[tuple[str, ...]], dependents: list[str] | None = None, drop_null_determinants: bool = False, nulls_are_values: bool = False, names: list[str] | None = None) -> DataFrame:
    """determinant (joined by +, or its name), dependent, ratio: the share of the determinant's groups with exactly
    one non-null value of the dependent; with nulls_are_values, one value in all, a null being one.

    Nulls of a determinant form a group unless they are dropped; without groups the ratio is 1 (nothing speaks
    against it). The result has a row for every pair, so it stays small whatever the table's size.
    """
    df = plain(df.drop(ROW_ORDER))
    value = {f.name: _q(f.name) if isinstance(f.dataType, _NARROW) else F.when(_q(f.name).isNotNull(), F.xxhash64(_q(f.name))) for f in df.schema}
    out = None
    for x, name in zip(determinants, names or ["+".join(x) for x in determinants], strict=True):
        ys = [y for y in (dependents or df.columns) if y not in x]
        if not ys:
            continue
        rows = df
        if drop_null_determinants:
            for c in x:
                rows = rows.where(_q(c).isNotNull())
        measures = [("lo", F.min), ("hi", F.max), *([("k", F.count)] if nulls_are_values else [])]
        groups = rows.groupBy(*[_q(c) for c in x]).agg(F.count("*").alias("n"), *[m(value[y]).alias(f"{k}{i}") for i, y in enumerate(ys) for k, m in measures])
        one = lambda i: (F.col(f"lo{i}") == F.col(f"hi{i}")) & (F.col(f"k{i}") == F.col("n")) | (F.col(f"k{i}") == 0) if nulls_are_values else F.col(f"lo{i}") == F.col(f"hi{i}")
        same = [F.coalesce(F.avg(F.coalesce(one(i).cast("int"), F.lit(0))), F.lit(1.0)).alias(f"r{i}") for i in range(len(ys))]
        row = F.array(*[F.struct(F.lit(y).alias("dependent"), F.col(f"r{i}").alias("ratio")) for i, y in enumerate(ys)])
        part = groups.agg(*same).select(F.lit(name).alias("determinant"), F.explode(row).alias("r")).select("determinant", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def fd_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every single column against every other."""
    columns = columns or [c for c in df.columns if c != ROW_ORDER]
    return ratios(df.select(*[_q(c) for c in columns]), [(c,) for c in columns])


def _numbers(hashes) -> np.ndarray:
    """Equal numbers from 0 on for equal hashes, -1 for nulls; the hashes stay whole (floats would lose bits)."""
    out = np.full(len(hashes), -1, np.int64)
    there = np.flatnonzero(~np.asarray(hashes.is_null()))
    out[there] = np.unique(hashes.drop_null().to_numpy(), return_inverse=True)[1]
    return out


class Sample:
    """The first REFUTING_ROWS rows as numbers (equal ones for equal values, -1 for null) to refute rules with. Values are
    told apart by 64-bit hashes, which are all different in 10^5 rows but for a chance of 3 in 10^10 for each column."""

    def __init__(self, df: DataFrame):
        df = plain(df.drop(ROW_ORDER)).limit(REFUTING_ROWS)
        got = df.select(*[F.when(_q(c).isNotNull(), F.xxhash64(_q(c))).alias(str(i)) for i, c in enumerate(df.columns)]).toArrow()
        self.columns = {c: _numbers(got.column(i)) for i, c in enumerate(df.columns)}

    def _codes(self, x: tuple[str, ...]) -> np.ndarray:
        """Equal numbers for rows with equal values of x."""
        out, size = np.zeros(len(next(iter(self.columns.values()))), np.int64), 1
        for c in x:
            v = self.columns[c]
            width = int(v.max(initial=0)) + 2
            if size * width >= 1 << 62:
                kinds, out = np.unique(out, return_inverse=True)
                size = len(kinds)
            out, size = out * width + v + 1, size * width
        return out

    def groups(self, x: tuple[str, ...], drop_nulls: bool = False) -> np.ndarray:
        """The group of every row; -1 for rows that a null leaves out."""
        out = np.unique(self._codes(x), return_inverse=True)[1]
        return np.where(np.any([self.columns[c] < 0 for c in x], axis=0), -1, out) if drop_nulls else out

    def duplicates(self, s: tuple[str, ...]) -> bool:
        """Whether some combination of values occurs twice (nulls are equal)."""
        codes = np.sort(self._codes(s))
        return bool((codes[1:] == codes[:-1]).any())

    def violations(self, groups: np.ndarray, y: str) -> int:
        """Groups with more than one non-null value of y."""
        v = self.columns[y]
        there = (v >= 0) & (groups >= 0)
        pairs = np.unique(groups[there] * (v.max(initial=0) + 1) + v[there])
        return int((np.unique(pairs // (v.max(initial=0) + 1), return_counts=True)[1] > 1).sum())


def collect_ratios(df: DataFrame, determinants: list[tuple[str, ...]], dependents: list[str] | None = None, drop_null_determinants: bool = False, at_least: float = 0.0, facts: TableFacts | None = None, nulls_are_values: bool = False) -> dict[tuple[tuple[str, ...], str], float]:
    """The matrix as facts for the rules, a few determinants per job.

    With at_least, pairs below it may be left out: those that the sample refutes (any violation refutes 1; fewer are
    told from the number of groups, which facts know for single columns).
    """
    columns = [c for c in df.columns if c != ROW_ORDER]
    wanted = {x: [y for y in (dependents or columns) if y not in x] for x in determinants}
    if at_least > 0 and any(wanted.values()):
        sample = Sample(df.select(*[_q(c) for c in columns if c in {c for x, ys in wanted.items() for c in (*x, *ys)}]))
        for x, ys in wanted.items():
            groups = sample.groups(x, drop_null_determinants)
            most = facts.unique[x[0]] + 1 if facts and len(x) == 1 else None
            limit = 0 if at_least >= 1 else (1 - at_least) * most + 1e-9 if most is not None else None
            wanted[x] = ys if limit is None else [y for y in ys if sample.violations(groups, y) <= limit]
    found, alike = {}, {}
    for x, ys in wanted.items():
        if ys:
            alike.setdefault(tuple(ys) if at_least > 0 else tuple(dependents or columns), []).append(x)
    jobs = [(list(ys), xs[at : at + DETERMINANTS_PER_JOB]) for ys, xs in alike.items() for at in range(0, len(xs), DETERMINANTS_PER_JOB)]
    frames, names = [], {}
    for ys, xs in jobs:
        mine = [str(len(names) + i) for i in range(len(xs))]  # names with a + in them could be mistaken for others
        names |= dict(zip(mine, xs, strict=True))
        if (rows := ratios(df, xs, ys, drop_null_determinants, nulls_are_values, mine)) is not None:
            frames.append((rows, len(xs)))
    while frames:  # unions of branches, DETERMINANTS_PER_JOB at a time
        rows, n = frames.pop()
        while frames and n + frames[-1][1] <= DETERMINANTS_PER_JOB:
            more, m = frames.pop()
            rows, n = rows.unionByName(more), n + m
        found |= {(names[r[0]], r[1]): r[2] for r in rows.collect()}
    return found


def free_of_duplicates(df: DataFrame, sets: list[tuple[str, ...]], distinct: dict[str, int] | None = None) -> list[tuple[str, ...]]:
    """Those of the sets whose combinations are all different (nulls are equal).

    The columns are written once. Sets are refuted first on all rows of a few values: each set by its column with most
    distinct values (by ``distinct``, else its first), one value in so many of FIRST_LOOKS by its hash, so that rows that
    are equal in a set are looked at together; a duplicate there is one in the table. What this leaves is asked of all rows by
    a 64-bit hash for each set, a few sets in one shuffle. Rows of equal hashes are then compared by their values.
    """
    if not sets:
        return []
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = saved(_spread(plain(df.drop(ROW_ORDER))).select(*map(_q, columns)), "rows")
    size = rows.count()
    lead = {s: max(s, key=lambda c: (distinct or {}).get(c, 0)) for s in sets}
    for one_in in FIRST_LOOKS:
        parts = [sets[at : at + SETS_PER_SCAN] for at in range(0, len(sets), SETS_PER_SCAN)]
        sets = [s for part in parts for s in _without(part, _seen_twice(rows, part, lead, one_in))]
    per_task = -(-size // max(rows.rdd.getNumPartitions(), 1))
    step = min(SETS_PER_SCAN, max(1, HASHES_PER_TASK // max(per_task, 1)))
    parts = [sets[at : at + step] for at in range(0, len(sets), step)]
    return [s for part in parts for s in _without(part, _repeated(rows, part, size))]


def _without(sets: list[tuple[str, ...]], places: set[int]) -> list[tuple[str, ...]]:
    return [s for i, s in enumerate(sets) if i not in places]


def _seen_twice(rows: DataFrame, sets: list[tuple[str, ...]], lead: dict[tuple[str, ...], str], one_in: int) -> set[int]:
    """Places of sets with a duplicate among the rows of one value in one_in of their leading column."""
    groups: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        groups.setdefault(lead[s], []).append(i)
    seen = None
    for c, places in groups.items():
        hashes = [F.struct(F.lit(i).alias("set"), *wide_hash([_q(x) for x in sets[i]])) for i in places]
        part = rows.where(F.pmod(row_hash([_q(c)], 2), F.lit(one_in)) == 0).select(F.inline(F.array(*hashes)))
        seen = part if seen is None else seen.unionByName(part)
    return {r[0] for r in seen.groupBy("set", "g0", "g1").count().where("count > 1").select("set").distinct().collect()} if groups else set()  # as many as sets at most


def _repeated(rows: DataFrame, sets: list[tuple[str, ...]], size: int) -> set[int]:
    """Places of sets with a duplicate among all rows.

    Hashes are nearly all different here, so none are counted before they move, and they go to tasks of
    HASHES_IN_A_TASK, which bounds the memory of one.
    """
    g = {i: row_hash([_q(c) for c in s]) for i, s in enumerate(sets)}
    hashes = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("set"), h.alias("g")) for i, h in g.items()])))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size * len(sets) // HASHES_IN_A_TASK))
    twice = hashes.repartition(tasks, "set", "g").groupBy("set", "g").count().where("count > 1").groupBy("set").agg(F.min("g").alias("least"), F.max("g").alias("most")).collect()  # as many as sets at most
    found = set()
    for r in twice:
        s, h = sets[r["set"]], g[r["set"]]
        again = lambda some: not some.groupBy(*map(_q, s)).count().where("count > 1").isEmpty()  # noqa: B023, E731
        if again(rows.where(h.isin(r["least"], r["most"]))) or again(rows):  # the second only after two hashes met by chance
            found.add(r["set"])
    return found


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores goes to all of them; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def unique_sets(df: DataFrame, columns: list[str], stats: dict[str, tuple[int, int]], n_rows: int, max_size: int = MAX_DETERMINANT, minimal: bool = True) -> list[tuple[str, ...]]:
    """Column sets without duplicate combinations, from size 1 up.

    stats: column -> (distinct values, non-nulls). A set whose distinct counts multiply to fewer than n_rows
    can't be unique and a superset of a unique one always is; what is left is refuted on a sample or tested.
    """
    found: list[tuple[str, ...]] = []
    sample = None
    for size in range(1, min(max_size, len(columns)) + 1):
        open_sets, implied = [], []
        for s in combinations(columns, size):
            if any(set(u) <= set(s) for u in found):
                implied.append(s)
                continue
            most = 1
            for c in s:
                unique, known = stats[c]
                most *= unique + (known < n_rows)
            if most >= n_rows:
                open_sets.append(s)
        new = [s for s in open_sets if n_rows <= 1]
        if n_rows > 1 and open_sets:
            sample = sample or Sample(df.select(*[_q(c) for c in columns]))
            open_sets = [s for s in open_sets if not sample.duplicates(s)]
            new += free_of_duplicates(df, open_sets, {c: stats[c][0] for c in columns})
        found += new + ([] if minimal else implied)
    return found


@dataclass
class TableFacts:
    """What the rules know of one table; every number comes from a Spark job."""

    name: str
    columns: list[str]
    n_rows: int
    unique: dict[str, int]
    non_null: dict[str, int]
    candidate_keys: list[tuple[str, ...]] = field(default_factory=list)
    primary_key: tuple[str, ...] = ()
    dependencies: dict[str, list[str]] = field(default_factory=dict)
    partial: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    transitive: list[tuple[tuple[str, ...], str, list[str]]] = field(default_factory=list)
    violates_2nf: bool = False
    violates_3nf: bool = False

    def is_unique(self, c: str) -> bool:
        return self.unique[c] == self.n_rows and self.non_null[c] == self.n_rows


def _facts_of(name: str, rows: list) -> TableFacts:
    return TableFacts(name, [r["column_name"] for r in rows], rows[0]["total_count"] if rows else 0, {r["column_name"]: r["unique_count"] for r in rows}, {r["column_name"]: r["non_null_count"] for r in rows})


def measure(df: DataFrame, name: str) -> TableFacts:
    return measure_all({name: df})[name]


def measure_all(tables: dict[str, DataFrame]) -> dict[str, TableFacts]:
    """The measures of all tables, in one job."""
    from .profile import profile_all

    by_table: dict[str, dict] = {t: {} for t in tables}
    for r in profile_all(tables).collect() if tables else []:
        by_table[r["table_name"]][r["column_name"]] = r
    return {t: _facts_of(t, [by_table[t][c] for c in df.columns if c != ROW_ORDER]) for t, df in tables.items()}


def candidate_keys(df: DataFrame, facts: TableFacts, mode: str = "textbook", max_size: int = MAX_DETERMINANT) -> list[tuple[str, ...]]:
    """Identifier-named unique columns; without any, the smallest unique sets with an identifier-named member."""
    singles = [(c,) for c in facts.columns if facts.n_rows and naming.key_name(c, mode) and facts.is_unique(c)]
    if singles or not facts.n_rows:
        return singles
    stats = {c: (facts.unique[c], facts.non_null[c]) for c in facts.columns}
    sample = None
    for size in range(2, max_size + 1):
        sets = [s for s in combinations(facts.columns, size) if any(naming.has_any(c, naming.IDENTITY_PARTS) for c in s)]
        sets = [s for s in sets if _most(s, stats, facts.n_rows) >= facts.n_rows]
        if sets:
            sample = sample or Sample(df)
            sets = [s for s in sets if not sample.duplicates(s)]
        if found := free_of_duplicates(df, sets, facts.unique):
            return found
    return []


def _most(s: tuple[str, ...], stats: dict[str, tuple[int, int]], n: int) -> int:
    out = 1
    for c in s:
        out *= stats[c][0] + (stats[c][1] < n)
    return out


def genuine_entity(column: str, dependents: list[str], unique: int, n_rows: int) -> bool:
    """Whether a determinant with its dependents looks like an entity of its own, not a mere category."""
    base = naming.base_name(column)
    if len(dependents) == 1 and naming.has_any(dependents[0], naming.NAME_WORDS) and base in dependents[0].lower():
        return False
    if unique < 10 or unique < 0.05 * n_rows:
        return False
    named = naming.has_any(column, naming.ENTITY_WORDS)
    if naming.has_any(column, naming.CATEGORICAL_WORDS) and not named:
        return False
    return (named and len(dependents) >= 2) or any(naming.has_any(d, naming.CONTACT_WORDS) for d in dependents) or len(dependents) >= 3


def partial_dependencies(df: DataFrame, key: tuple[str, ...], columns: list[str], threshold: float = THRESHOLD) -> dict[tuple[str, ...], list[str]]:
    """Proper subsets of a composite key -> the other columns that they determine."""
    if len(key) < 2:
        return {}
    subsets = [s for size in range(1, len(key)) for s in combinations(key, size)]
    facts = collect_ratios(df, subsets, [c for c in columns if c not in key], at_least=threshold)
    out: dict[tuple[str, ...], list[str]] = {}
    for s in subsets:
        if hit := [c for c in columns if c not in key and facts.get((s, c), 0) >= threshold]:
            out[s] = hit
    return out


def transitive_dependencies(df: DataFrame, facts: TableFacts, mode: str = "textbook", threshold: float = THRESHOLD) -> list[tuple[tuple[str, ...], str, list[str]]]:
    """(key, A, [B, ...]) for key -> A -> B with A no key.

    ``textbook``: every A -> B counts, and A with all its B must look like an entity. ``compat``: B must also not
    depend on the key exactly (so it has nulls) and looks like an entity on its own.
    """
    key, others = facts.primary_key, [c for c in facts.columns if c not in facts.primary_key]
    if not key or not others:
        return []
    tests = [(c,) for c in others if not facts.is_unique(c)]
    known = collect_ratios(df, tests, others, at_least=threshold, facts=facts)
    exact = collect_ratios(df, [key], others)
    out = []
    for (a,) in tests:
        if exact.get((key, a), 0) < threshold:
            continue
        targets = [b for b in others if b != a and known.get(((a,), b), 0) >= threshold]
        if mode == "compat":
            targets = [b for b in targets if exact.get((key, b), 0) < 1 and genuine_entity(a, [b], facts.unique[a], facts.n_rows)]
        elif not targets or not genuine_entity(a, targets, facts.unique[a], facts.n_rows):
            continue
        if targets:
            out.append((key, a, targets))
    return out


def profile_table(df: DataFrame, name: str, mode: str = "textbook", full_matrix: bool = True) -> TableFacts:
    """All of the above for one table: measures, dependencies, keys, normal-form violations."""
    facts = measure(df, name)
    facts.candidate_keys = candidate_keys(df, facts, mode)
    facts.primary_key = min(facts.candidate_keys, key=len) if facts.candidate_keys else ()
    if full_matrix and facts.n_rows >= 2:
        known = collect_ratios(df, [(c,) for c in facts.columns], at_least=THRESHOLD, facts=facts)
        for (x, y), ratio in known.items():
            if ratio >= THRESHOLD:
                facts.dependencies.setdefault("+".join(x), []).append(y)
        stats = {c: (facts.unique[c], facts.non_null[c]) for c in facts.columns}
        for s in unique_sets(df, facts.columns, stats, facts.n_rows, min(MAX_DETERMINANT, len(facts.columns) - 1)) if len(facts.columns) > 2 else []:
            if len(s) > 1:
                facts.dependencies["+".join(s)] = [c for c in facts.columns if c not in s]
    facts.partial = partial_dependencies(df, facts.primary_key, facts.columns)
    facts.transitive = transitive_dependencies(df, facts, mode)
    facts.violates_2nf, facts.violates_3nf = bool(facts.partial), bool(facts.transitive)
    return facts


def summary(facts: dict[str, TableFacts]) -> str:
    lines = []
    for name, f in sorted(facts.items()):
        key = "+".join(f.primary_key) or "none"
        lines.append(f"{name}: {f.n_rows} rows, key {key}, {len(f.candidate_keys)} candidates, {sum(map(len, f.dependencies.values()))} dependencies, 2NF {'violated' if f.violates_2nf else 'holds'}, 3NF {'violated' if f.violates_3nf else 'holds'}")
    return "\n".join(lines)
