"""Decomposition into first, second and third normal form, key choice and surrogate keys.

Facts (counts and dependency ratios) are collected a job at a time; every table that results is a lazy
DataFrame over its source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from relforge.functions import inference, naming
from relforge.sources.catalog import ROW_ORDER, with_row_order
from relforge.sources.scratch import numbered

from . import decompose as pieces
from . import dependencies as deps
from .decompose import Decomposition
from .dependencies import TableFacts
from .foreign_keys import ForeignKey, infer_by_name
from .profile import HEAD_ROWS, SAMPLE, first_values, multivalued, samples, split_json


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# First normal form


def delimiter_counts(df: DataFrame, column: str, order: list[str], n: int = SAMPLE) -> DataFrame:
    """delimiter, n_rows: in how many of the first n values each stands, most first, then in the fixed order."""
    s = samples(df, column, n, order)
    counts = s.agg(*[F.count(F.when(F.contains("value", F.lit(d)), 1)).alias(f"d{i}") for i, d in enumerate(inference.SPLIT_DELIMITERS)])
    rows = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("rank"), F.col(f"d{i}").alias("n_rows")) for i, d in enumerate(inference.SPLIT_DELIMITERS)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def pick_delimiter(df: DataFrame, column: str, order: list[str]) -> str | None:
    best = delimiter_counts(df, column, order).orderBy(F.desc("n_rows"), "rank").first()
    return best["delimiter"] if best and best["n_rows"] else None


def explode_values(df: DataFrame, column: str, key: list[str], delimiter: str) -> DataFrame:
    """key columns and <column>_value, a row for each part of a delimited field. Parts are trimmed and empty ones
    go; a value without the delimiter stays as it is; nulls give no row and repeated parts stay."""
    v = _q(column).cast("string")
    parts = F.when(F.contains(v, F.lit(delimiter)), F.filter(F.transform(F.split(v, re.escape(delimiter)), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(v))
    return df.where(_q(column).isNotNull()).select(*[_q(k) for k in key], F.explode(parts).alias(f"{column}_value"))


def list_share(first: DataFrame, column: str) -> Column:
    """The share of the values that are JSON lists, as an aggregate over a table of first values."""
    v = _q(column)
    return F.avg(F.when(v.isNotNull(), (F.coalesce(F.try_parse_json(v).isNotNull(), F.lit(False)) & v.rlike(r"^\s*\[")).cast("int")))


def explode_list(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """key columns, <column>_position (from 0) and <column>_value (as text; an object or a list as JSON), a row for
    each element of an array or a JSON list. Empty lists and nulls give no row, a text that is no list stays as it is,
    and a null element is a row with a null. Commas and brackets inside an element don't cut it."""
    kind = df.schema[column].dataType
    if isinstance(kind, ArrayType):
        items = _q(column)
    else:
        listed = F.try_parse_json(_q(column)).isNotNull() & _q(column).rlike(r"^\s*\[")
        items = F.coalesce(F.when(listed, F.from_json(_q(column), "array<string>")), F.array(_q(column)))
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        items = F.transform(items, (lambda x: F.to_json(x)) if isinstance(inner, StructType | ArrayType | MapType) else lambda x: x.cast("string"))
    return df.where(_q(column).isNotNull()).select(*[_q(k) for k in key], F.posexplode(items).alias(f"{column}_position", f"{column}_value"))


def object_keys(df: DataFrame, column: str, key: list[str]) -> list[str]:
    """The keys of a list column's elements if the first ones, by key and position, are all JSON objects, else none.

    The lists of the first HEAD_ROWS rows are taken apart; those of all rows only if they hold fewer than SAMPLE values.
    """
    head = df.where(_q(column).isNotNull()).orderBy(*map(_q, key)).limit(HEAD_ROWS)
    for rows in (head, df):
        child = explode_list(rows, column, key)
        first = child.where(_q(f"{column}_value").isNotNull()).orderBy(*map(_q, [*key, f"{column}_position"])).limit(SAMPLE).select(F.json_object_keys(f"{column}_value").alias("k"))
        got = first.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("k").isNotNull()), F.lit(False)).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("keys")).first()  # SAMPLE values
        if got["n"] == SAMPLE:
            break
    return got["keys"] if got["all"] else []


def first_normal_form(name: str, df: DataFrame, key: list[str], columns: list[str], order: list[str]) -> dict[str, DataFrame]:
    """The table without its multivalued columns, and a table <name>_<column> for each of them.

    A list (an array, or most of the first values JSON lists) gives a row for each element with its position; a list of
    objects has a column <column>_<key> for each of their keys. Other columns are split at their delimiter.
    """
    out, rest, asked = {}, df, [c for c in columns if c not in key]
    arrays = {f.name for f in df.schema if isinstance(f.dataType, ArrayType)}
    shares = first_values(df, asked, SAMPLE, order).agg(*[list_share(df, c).alias(c) for c in asked]).first() if asked else {}
    for c in asked:
        if c in arrays or (shares[c] or 0) > 0.5:
            child = explode_list(df, c, key)
            if keys := object_keys(df, c, key):
                child = split_json(child.withColumnRenamed(f"{c}_value", c), c, keys)
            out[f"{name}_{c}"] = child
        elif (d := pick_delimiter(df, c, order)) is not None:
            out[f"{name}_{c}"] = explode_values(df, c, key, d)
        else:
            continue
        rest = rest.drop(c)
    return {name: rest, **out}


# Second and third normal form


def second_normal_form(name: str, df: DataFrame, partial: dict[tuple[str, ...], list[str]]) -> dict[str, DataFrame]:
    """A table <name>_<part of the key> with the different rows of that part and what depends on it, and the rest.
    Lossless only where the dependency holds in every row; ``decompose.split`` also bears exceptions."""
    out, rest = {}, df
    for part, attributes in partial.items():
        mine = [a for a in attributes if a in rest.columns]
        if mine:
            out[f"{name}_{'_'.join(part)}"] = df.select(*[_q(c) for c in (*part, *mine)]).dropDuplicates()
            rest = rest.drop(*mine)
    return {name: rest, **out}


def related_table(df: DataFrame, key: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the distinct key with its attributes, the table without the attributes)."""
    return df.select(_q(key), *[_q(a) for a in attributes]).dropDuplicates(), df.drop(*attributes)


@dataclass(frozen=True)
class Pattern:
    """Why a column's values repeat: event_history, status_history, line_items, sequenced_children, child_records."""

    kind: str


def multi_row_pattern(df: DataFrame, name: str, column: str, facts: TableFacts) -> Pattern | None:
    """None for a column without repeats (nulls are equal)."""
    nulls = facts.n_rows - facts.non_null[column]
    if facts.unique[column] + (nulls > 0) == facts.n_rows:
        return None
    if any(naming.has_any(c, naming.TEMPORAL_WORDS) for c in facts.columns):
        return Pattern("event_history")
    for c in (c for c in facts.columns if c != column):
        if naming.has_any(c, naming.STATUS_WORDS):
            varies = df.where(_q(column).isNotNull()).groupBy(_q(column)).agg(F.min(_q(c)).alias("lo"), F.max(_q(c)).alias("hi")).where("lo <> hi")
            if not varies.isEmpty():
                return Pattern("status_history")
    if naming.has_any(name, naming.ITEM_WORDS):
        return Pattern("line_items")
    if any(naming.has_any(c, naming.SEQUENCE_WORDS) for c in facts.columns):
        return Pattern("sequenced_children")
    return Pattern("child_records")


def chain_holds(df: DataFrame, key: tuple[str, ...], middle: str, targets: list[str], facts: TableFacts) -> bool:
    """key -> middle and middle -> some target, both exactly, with a middle that several key values share or that
    has clearly fewer values than the key."""
    if facts.n_rows < 2:
        return False
    found = deps.collect_ratios(df, [key, (middle,)], [middle, *targets], drop_null_determinants=True, at_least=1)
    if found.get((key, middle), 0) < 1 or not any(found.get(((middle,), t), 0) == 1 for t in targets):
        return False
    n_keys = df.select(*[_q(k) for k in key]).distinct().count()
    if facts.unique[middle] < 0.9 * n_keys:
        return True
    return not df.where(_q(middle).isNotNull()).groupBy(_q(middle)).agg(F.count_distinct(*[_q(k) for k in key]).alias("n")).where("n > 1").isEmpty()


@dataclass(frozen=True)
class Entity:
    is_entity: bool
    score: float
    kind: str


def entity_score(unique: int, n_rows: int, column: str, diverse: list[str]) -> Entity:
    """How much a determinant with its exact dependents looks like an entity: its number of dependents, the share
    of distinct values, a telling word in any of the names, and contact data among the dependents. Without a
    dependent, or with few values, it is none and scores 0."""
    ratio = unique / n_rows if n_rows else 0.0
    if unique < max(10, 0.01 * n_rows) or ratio < 0.02 or not diverse:
        return Entity(False, 0.0, "")
    score = 0.5 if len(diverse) >= 3 else 0.3 if len(diverse) == 2 else 0.1
    score += 0.2 if 0.05 <= ratio <= 0.7 else 0.1 if 0.02 <= ratio <= 0.9 else 0.0
    words = {w for c in (column, *diverse) for w in re.findall(r"[a-z]+", c.lower())}
    score += 0.2 if words - set(naming.COMMON_WORDS) else 0.0
    contact = any(naming.has_any(d, naming.STRUCTURAL_WORDS) for d in diverse)
    score = round(score + 0.3 * contact, 6)
    return Entity(score >= 0.4, score, "" if score < 0.4 else "master" if ratio > 0.5 else "reference" if contact else "lookup")


def entities(name: str, df: DataFrame, facts: TableFacts, mode: str = "textbook") -> list[tuple[str, str, list[str]]]:
    """(table name, column, attributes) for every entity or repeating group that hangs on a non-key column.

    ``compat`` asks for a repeating group first and names it after that; ``textbook`` asks for an entity first and
    names the table after the column.
    """
    out, left = [], set(df.columns)
    for key, a, targets in facts.transitive:
        mine = [t for t in targets if t in left and t not in key]
        if not mine or a not in left or not chain_holds(df, key, a, mine, facts):
            continue
        exact = deps.collect_ratios(df, [(a,)], mine, drop_null_determinants=True, at_least=1)
        diverse = [t for t in mine if exact.get(((a,), t), 0) == 1]
        entity, pattern = entity_score(facts.unique[a], facts.n_rows, a, diverse), multi_row_pattern(df, name, a, facts)
        if mode == "compat" and pattern:
            wanted, moved = f"{name}_{pattern.kind}", mine
        elif entity.is_entity:
            wanted, moved = naming.base_name(a) or a, diverse
        elif pattern and mode != "compat":
            wanted, moved = f"{name}_{naming.base_name(a) or a}", diverse
        else:
            continue
        if moved:
            out.append((wanted, a, moved))
            left -= set(moved)
    return out


def third_normal_form(name: str, df: DataFrame, facts: TableFacts, mode: str = "textbook") -> dict[str, DataFrame]:
    """A table of different rows for each of the entities, and the rest. Lossless only where the dependency holds in
    every row; ``decompose.split`` also bears exceptions."""
    out, rest = {}, df
    for wanted, a, moved in entities(name, df, facts, mode):
        out[naming.unique_name(wanted, {name, *out})], rest = related_table(rest, a, moved)
    return {name: rest, **out}


# Keys


@dataclass(frozen=True)
class KeyChoice:
    columns: tuple[str, ...]
    surrogate: bool
    score: int = 0


def suitable(column: str, facts: TableFacts, mode: str = "textbook") -> bool:
    """Whether a column may be the primary key: named like an identifier, not like a business attribute, unique."""
    strength = naming.identity(column, mode).strength
    if not strength or (strength == "moderate" and naming.has_any(column, naming.PRIMARY_KEY_BLACKLIST)):
        return False
    return facts.n_rows > 0 and facts.is_unique(column)


def repeating_foreign_key(name: str, column: str, facts: TableFacts, known: list[ForeignKey]) -> bool:
    declared = any((k.fk_table, k.fk_column) == (name, column) for k in known)
    named = column.lower().endswith("_id") and column.lower() != f"{name.lower()}_id"
    nulls = facts.n_rows - facts.non_null[column]
    return (declared or named) and facts.unique[column] + (nulls > 0) < facts.n_rows


def foreign_key_column(name: str, columns: tuple[str, ...], known: list[ForeignKey]) -> bool:
    """Whether a declared foreign key of the table is among the columns."""
    return any(k.fk_table == name and k.fk_column in columns for k in known)


def choose_key(name: str, facts: TableFacts, known: list[ForeignKey], composites: list[tuple[str, ...]] = (), mode: str = "textbook") -> KeyChoice:
    """The best natural key by its name and form, else a surrogate <name>_id under a free name."""
    best: tuple[int, tuple[str, ...]] | None = None
    for c in facts.columns:
        if repeating_foreign_key(name, c, facts, known) or not suitable(c, facts, mode) or foreign_key_column(name, (c,), [k for k in known if k.pk_table != name]):
            continue
        low = c.lower()
        score = 100 + (20 if naming.identity(c, mode).strength == "high" else 10) - 5 * (len(c) > 20)
        score += 15 if low.endswith("_id") else 10 if low.endswith(("_key", "_code")) else 0
        if best is None or score > best[0]:
            best = (score, (c,))
    for s in composites:
        if len(s) > 1 and not foreign_key_column(name, s, known) and any(naming.identity(c, mode) for c in s) and (best is None or 85 - 5 * len(s) > best[0]):
            best = (85 - 5 * len(s), tuple(s))
    if best:
        return KeyChoice(best[1], False, best[0])
    return KeyChoice((naming.unique_name(f"{name}_id", facts.columns),), True)


def surrogate_key(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with a first column that numbers the rows from 1 in the given order; rows that tie come in any order.

    The numbered rows are written once (see ``scratch.numbered``), so every reader of the result sees the same key.
    """
    return numbered(df, [_q(o) for o in order], column)


# The whole of it


@dataclass
class Normalized:
    tables: dict[str, DataFrame]
    keys: dict[str, tuple[str, ...]]
    sources: dict[str, str]
    foreign_keys: list[ForeignKey]
    warnings: list[str] = field(default_factory=list)
    decompositions: list[Decomposition] = field(default_factory=list)


def move_to_parent(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], known: list[ForeignKey], mode: str = "textbook") -> dict[str, DataFrame]:
    """Columns of a child that its foreign key alone determines, moved to the parent by a left join.

    A column moves if it is no identifier, the parent has no column of that name, and it depends on the foreign key
    exactly: in ``textbook`` mode with nulls as values, and without a value in rows whose foreign key is null, so that
    nothing is lost; in ``compat`` mode nulls aside.
    """
    out = dict(tables)
    for k in known:
        if k.more or k.fk_table == k.pk_table or k.fk_table not in out or k.pk_table not in out or k.fk_column not in out[k.fk_table].columns:
            continue
        child, parent = out[k.fk_table], out[k.pk_table]
        free = [c for c in child.columns if c not in (k.fk_column, *keys.get(k.fk_table, ()), ROW_ORDER) and not naming.identity(c) and c not in parent.columns]
        free = [c for c in free if not any((o.fk_table, o.fk_column) == (k.fk_table, c) for o in known)]
        if not free:
            continue
        slim = child.select(_q(k.fk_column), *map(_q, free))
        found = deps.collect_ratios(slim, [(k.fk_column,)], free, drop_null_determinants=True, at_least=1, nulls_are_values=mode != "compat")
        moved = [c for c in free if found.get(((k.fk_column,), c), 0) == 1]
        if moved and mode != "compat":
            alone = slim.where(_q(k.fk_column).isNull()).agg(*[F.count(_q(c)).alias(c) for c in moved]).first()
            moved = [c for c in moved if not alone[c]]
        if moved:
            known_rows, rest = related_table(child.where(_q(k.fk_column).isNotNull()), k.fk_column, moved)
            out[k.pk_table] = parent.join(known_rows.withColumnRenamed(k.fk_column, "_moved_key"), parent[k.pk_column] == F.col("_moved_key"), "left").drop("_moved_key")
            out[k.fk_table] = child.drop(*moved)
    return out


def placement(df: DataFrame, key: tuple[str, ...], attribute: str, columns: list[str]) -> str | None:
    """What an attribute depends on: the key ('key'), else the first other column that determines it, else None."""
    found = deps.collect_ratios(df, [key, *[(c,) for c in columns if c != attribute and (c,) != key]], [attribute], drop_null_determinants=True, at_least=1)
    if found.get((key, attribute), 0) == 1:
        return "key"
    return next((c for c in columns if c != attribute and found.get(((c,), attribute), 0) == 1), None)


def missing_columns(original: list[str], pieces: dict[str, list[str]]) -> list[str]:
    """Columns of a source that none of its pieces holds, split values included."""
    held = {c for columns in pieces.values() for c in columns}
    return [c for c in original if c != ROW_ORDER and c not in held and f"{c}_value" not in held and f"{c}_position" not in held]


def decompose(name: str, df: DataFrame, facts: TableFacts, taken: set[str], mode: str = "textbook") -> Decomposition:
    """A table (with its row order) through 1NF, 2NF and 3NF, as pieces that know their keys and references.

    ``textbook`` splits are lossless whatever the data (see ``decompose.split``); ``compat`` takes different rows of
    what nearly always depends, and declares no keys or references of these pieces.
    """
    order, key = [ROW_ORDER], facts.primary_key
    listed = [r["column_name"] for r in multivalued(df, name, facts.columns, order, mode).where("is_multivalued").collect()] if facts.n_rows else []
    if not key and listed:  # a split needs something to point back to
        column = naming.unique_name(f"{name}_id", facts.columns)
        df, key = surrogate_key(df, column, order), (column,)
    used = {*taken, name}

    def fresh(wanted: str) -> str:
        used.add(made := naming.unique_name(wanted, used))
        return made

    first = first_normal_form(name, df, list(key), listed, order)
    rest = pieces.Piece(name, first.pop(name), name, "rest", (), tuple(facts.columns), key)
    splits = []
    for wanted, values in first.items():
        own = fresh(wanted)
        back = pieces.reference(own, key, name) if mode != "compat" else None
        place = next((c for c in values.columns if c not in key and c.endswith("_position")), None)
        splits.append(pieces.Piece(own, values, name, "values", key, tuple(c for c in values.columns if c not in key), (*key, place) if place and mode != "compat" else (), back))
    if mode == "compat":
        parts = second_normal_form(name, rest.df, facts.partial)
        lookups = third_normal_form(name, parts[name], facts, mode)
        splits += [pieces.Piece(fresh(w), d, name, k) for k, found in (("part", parts), ("entity", lookups)) for w, d in found.items() if w != name]
        return Decomposition(name, pieces.Piece(name, lookups[name], name, "rest", (), (), key), splits)
    for part, attributes in facts.partial.items():
        rest, made = pieces.split(rest, fresh(f"{name}_{'_'.join(part)}"), part, attributes, "part", key)
        splits += made
    rest, made = _entities_split(rest, facts, fresh)
    splits += made
    todo = [p for p in splits if p.kind in ("part", "entity")]
    while todo:  # what a piece holds may depend on another of its columns again
        piece = todo.pop(0)
        if len(piece.attributes) > 1:
            own = deps.measure(piece.df, piece.name)
            own.primary_key = piece.key
            own.transitive = deps.transitive_dependencies(piece.df, own, mode)
            left, made = _entities_split(piece, own, fresh)
            splits[splits.index(piece)] = left
            splits += made
            todo += [p for p in made if p.kind == "entity"]
    return Decomposition(name, rest, splits)


def _entities_split(piece: pieces.Piece, facts: TableFacts, fresh) -> tuple[pieces.Piece, list[pieces.Piece]]:
    splits = []
    for wanted, a, moved in entities(piece.name, piece.df, facts) if facts.transitive else []:
        piece, made = pieces.split(piece, fresh(wanted), (a,), moved, "entity", piece.key)
        splits += made
    return piece, splits


def _moved_references(found: list[Decomposition], known: list[ForeignKey]) -> list[ForeignKey]:
    """The known keys where their columns are now: in the rest, or in the piece that an attribute moved to."""
    out = []
    for k in known:
        for d in found:
            if d.source == k.fk_table:
                homes = [p for p in d.pieces if p.kind != "values" and all(c in p.df.columns for c in k.columns)]
                home = next((p for p in homes if p.kind == "rest"), homes[0] if homes else None)
                if home:
                    out.append(replace(k, fk_table=home.name))
    return out


def normalize(tables: dict[str, DataFrame], facts: dict[str, TableFacts], known: list[ForeignKey], mode: str = "textbook") -> Normalized:
    """All tables through 1NF, 2NF and 3NF, with keys, moved attributes and foreign keys between the pieces.

    In ``textbook`` mode a piece's key is its determinant and the reference to it is declared, both by construction;
    a determinant that is not named like an identifier gets a surrogate beside it, which replaces it in the table that
    refers to it.
    """
    found, warnings, taken = [], [], set()
    for name, df in sorted(tables.items()):
        df = with_row_order(df)
        d = decompose(name, df, facts[name], taken | (set(tables) - {name}), mode)
        lost = missing_columns(df.columns, {p.name: p.df.columns for p in d.pieces})
        warnings += [f"{name}: column {c} is in no table" for c in lost]
        warnings += [f"{name}: {p.name} holds rows that deviate from {'+'.join(p.determinant)} -> {', '.join(p.attributes)}" for p in d.splits if p.kind == "exceptions"]
        found.append(d)
        taken |= {p.name for p in d.pieces}
    made = [p for d in found for p in d.pieces]
    out, sources = {p.name: p.df for p in made}, {p.name: p.source for p in made}
    keys = {p.name: p.key for p in made if p.key}
    declared = [p.reference for p in made if p.reference]
    out = move_to_parent(out, keys, known, mode)
    for p in (p for p in made if p.kind == "entity" and p.reference and not naming.identity(p.determinant[0], mode)):
        column = naming.unique_name(f"{p.name}_id", out[p.name].columns)
        out[p.name] = surrogate_key(out[p.name], column, list(p.determinant))
        own = [k for k in declared if k.pk_table == p.name]
        moved = pieces.translate(p, out[p.name], column, [(k.fk_table, out[k.fk_table], k) for k in own])
        declared = [k for k in declared if k.pk_table != p.name]
        for child, (frame, link) in moved.items():
            out[child] = frame
            declared.append(link)
        keys[p.name] = (column,)
    for name in list(out):
        if keys.get(name):
            continue
        own = deps.measure(out[name].drop(ROW_ORDER), name)
        choice = choose_key(name, own, known, mode=mode)
        if choice.surrogate:
            frame = out[name]
            order = [ROW_ORDER] if ROW_ORDER in frame.columns else frame.columns
            out[name] = surrogate_key(frame, choice.columns[0], order)
        keys[name] = choice.columns
    new = declared + [k for k in _moved_references(found, known) if k.pk_table in out and all(c in out[k.fk_table].columns for c in k.columns)]
    new += infer_by_name({n: d.drop(ROW_ORDER) for n, d in out.items()}, keys, new, key_parts=mode != "compat")
    return Normalized({n: d.drop(ROW_ORDER) for n, d in out.items()}, keys, sources, new, warnings, found)


def summary(found: Normalized) -> str:
    return "\n".join([f"{len(found.tables)} tables", *[f"{n} (from {found.sources.get(n, n)}): {len(d.columns)} columns, key {'+'.join(found.keys.get(n, ())) or 'none'}" for n, d in sorted(found.tables.items())]])
