"""Oracle DDL, constraints and indexes from facts about tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from relforge.functions import graphs, naming
from relforge.operators.dependencies import TableFacts
from relforge.operators.foreign_keys import ForeignKey

NOT_NULL_BELOW = 0.05
TIME_LENGTH = 5


def sized(column: str, kind: str) -> str:
    """A text type for a column with 'time' in its name holds five characters at least."""
    m = re.fullmatch(r"VARCHAR2?\((\d+)\)", kind)
    return f"VARCHAR2({TIME_LENGTH})" if m and "time" in column.lower() and int(m[1]) < TIME_LENGTH else kind


def not_null(column: str, key: tuple[str, ...], null_count: int, n_rows: int, mode: str = "textbook") -> bool:
    if column in key:
        return True
    if not n_rows:
        return False
    return null_count / n_rows < NOT_NULL_BELOW if mode == "compat" else null_count == 0


def references(table: str, column: str, foreign: list[ForeignKey]) -> bool:
    """Whether a column is a foreign key of its table."""
    return any(k.fk_table == table and column in k.columns for k in foreign)


def pick_key(table: str, facts: TableFacts, foreign: list[ForeignKey]) -> tuple[str, ...]:
    """The key for the DDL: the mined key unless it is a business or a foreign column on its own; a unique <...>_id
    that references nothing; the foreign keys of an associative table; any unique identifier; any unique plain column;
    else the mined key after all, and none without one. Every answer is unique."""
    refs = {c for c in facts.columns if references(table, c, foreign)}
    unique = [c for c in facts.columns if facts.n_rows and facts.is_unique(c)]
    key = facts.primary_key
    if key and (len(key) > 1 or key[0] not in refs) and not any(map(naming.business_name, key)):
        return key
    for c in unique:
        if c not in refs and c.lower().endswith("_id"):
            return (c,)
    fk = tuple(c for c in facts.columns if c in refs)
    if len(fk) >= 2 and len(facts.columns) - len(fk) <= 2 and tuple(sorted(fk)) in {tuple(sorted(k)) for k in facts.candidate_keys}:
        return fk
    for test in (lambda c: c.lower().endswith(tuple(naming.KEY_PARTS)), lambda c: not naming.business_name(c)):
        for c in unique:
            if c not in refs and test(c):
                return (c,)
    return key


def create_table(table: str, columns: list[tuple[str, str, bool]], key: tuple[str, ...]) -> str:
    """columns: (name, type, not null)."""
    name = naming.sanitize(table)
    lines = [f"    {naming.sanitize(c)} {sized(c, kind)}{' NOT NULL' if required else ''}" for c, kind, required in columns]
    if key:
        lines.append(f"    CONSTRAINT {naming.shorten(f'pk_{name}')} PRIMARY KEY ({', '.join(map(naming.sanitize, key))})")
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n);"


def valid_target(key: ForeignKey, keys: dict[str, tuple[str, ...]], facts: dict[str, TableFacts]) -> bool:
    """Whether the referenced columns are unique: they are the whole key, or a candidate key, in any order."""
    asked = sorted(key.targets)
    if sorted(keys.get(key.pk_table, ())) == asked:
        return True
    return key.pk_table in facts and asked in [sorted(k) for k in facts[key.pk_table].candidate_keys]


def composite_target(child_columns: list[str], parent_key: tuple[str, ...]) -> bool:
    """Whether a child holds every column of its parent's composite key."""
    return len(parent_key) > 1 and set(parent_key) <= set(child_columns)


@dataclass(frozen=True)
class Constraints:
    statements: list[str]
    skipped: list[str]
    kept: list[ForeignKey]


def foreign_key_constraints(foreign: list[ForeignKey], keys: dict[str, tuple[str, ...]], facts: dict[str, TableFacts]) -> Constraints:
    out, skipped, kept, edges = [], [], [], []
    for k in foreign:
        if k.fk_table not in facts or k.pk_table not in facts:
            skipped.append(f"{k.fk_table}.{k.fk_column}: a table is missing")
        elif not valid_target(k, keys, facts):
            parent = keys.get(k.pk_table, ())
            if k.pk_column in parent and not k.more and not composite_target(facts[k.fk_table].columns, parent):
                why = f"the key of {k.pk_table} is {', '.join(parent)} and {k.fk_table} does not hold all of it"
            else:
                why = f"{k.pk_table}.{', '.join(k.targets)} is not unique on its own"
            skipped.append(f"{k.fk_table}.{', '.join(k.columns)}: {why}")
        elif graphs.closes_cycle(edges, k.fk_table, k.pk_table, allow_self=True):
            skipped.append(f"{k.fk_table}.{k.fk_column}: closes a cycle")
        else:
            edges.append((k.fk_table, k.pk_table))
            kept.append(k)
            child = naming.sanitize(k.fk_table)
            name = naming.shorten(f"fk_{child}_{len(kept)}")
            out.append(f"ALTER TABLE {child}\n    ADD CONSTRAINT {name}\n    FOREIGN KEY ({', '.join(map(naming.sanitize, k.columns))})\n    REFERENCES {naming.sanitize(k.pk_table)}({', '.join(map(naming.sanitize, k.targets))});")
    return Constraints(out, skipped, kept)


def indexes(foreign: list[ForeignKey]) -> list[str]:
    return [f"CREATE INDEX {naming.shorten(f'idx_{naming.sanitize(k.fk_table)}_{i}')} ON {naming.sanitize(k.fk_table)}({', '.join(map(naming.sanitize, k.columns))});" for i, k in enumerate(foreign, 1)]


def script(facts: dict[str, TableFacts], types: dict[tuple[str, str], str], keys: dict[str, tuple[str, ...]], foreign: list[ForeignKey], mode: str = "textbook") -> str:
    """The whole schema as one text: commented drops in reverse, tables (referenced ones first), keys, indexes."""
    order = graphs.ordered(sorted(facts), [(k.fk_table, k.pk_table) for k in foreign])
    made = foreign_key_constraints(foreign, keys, facts)
    parts = ["-- Schema in third normal form", *[f"-- DROP TABLE {naming.sanitize(t)} CASCADE CONSTRAINTS;" for t in reversed(order)]]
    for t in order:
        f = facts[t]
        columns = [(c, types.get((t, c), "VARCHAR2(4000)"), not_null(c, keys.get(t, ()), f.n_rows - f.non_null[c], f.n_rows, mode)) for c in f.columns]
        parts.append(create_table(t, columns, keys.get(t, ())))
    parts += made.statements + [f"-- skipped {s}" for s in made.skipped] + indexes(made.kept) + ["COMMIT;"]
    return "\n\n".join(parts) + "\n"
