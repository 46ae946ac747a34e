"""Splits of a table that lose nothing, and pieces that know where they come from.

A split moves attributes to a table of their determinant. The determinant is that table's key and the source refers to
it: both follow from the split and need no measuring. Where the dependency holds in nearly all groups only, a group's
rows don't agree; then the new table has the combination that most of the group's rows have, and the rows that deviate
keep their values in a table of exceptions under the source's key. Nulls are values here: a group of a value and a
null does not agree.

Rebuilding a source joins its pieces back in the opposite order and lets the exceptions override. So the pieces are
lossless whatever the data, and ``validate.rejoin_difference`` measures it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relforge.sources.scratch import saved

from .foreign_keys import ForeignKey

#: A value of a join key is spread over SALTS tasks if it has more than this share of the rows (so at most
#: 1 / HOT_SHARE values are).
HOT_SHARE, SALTS = 0.001, 64
#: Determinants with several combinations that are broadcast, by their keys alone; more are joined.
FEW_ODD = 200_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass(frozen=True)
class Piece:
    """A table of a decomposition.

    kind: 'rest' (what is left of the source), 'values' (of a list, 1NF), 'part' (of a key, 2NF), 'entity' (3NF) or
    'exceptions' (rows that deviate from a part or an entity). determinant: what its attributes depend on, in the
    source's names. key: () where the rows of the piece have none. reference: the foreign key that the split makes,
    from the source to a part or an entity, and from values and exceptions to the source.
    """

    name: str
    df: DataFrame
    source: str
    kind: str
    determinant: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    reference: ForeignKey | None = None


@dataclass
class Decomposition:
    """The pieces of one source in the order of their splits, the rest first."""

    source: str
    rest: Piece
    splits: list[Piece] = field(default_factory=list)

    @property
    def pieces(self) -> list[Piece]:
        return [self.rest, *self.splits]


def reference(child: str, columns: tuple[str, ...], parent: str, targets: tuple[str, ...] | None = None, relationship: str = "many-to-one", reason: str = "split") -> ForeignKey:
    """A foreign key of one column or several."""
    targets = targets or columns
    return ForeignKey(child, columns[0], parent, targets[0], relationship, reason, tuple(zip(columns[1:], targets[1:], strict=True)))


def _no_null(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & _q(c).isNotNull()
    return out


def agreed(df: DataFrame, determinant: tuple[str, ...], attributes: list[str]) -> DataFrame:
    """determinant and attributes: for each determinant without a null the combination of attributes that most of its
    rows have, of several the greatest (a null is less than any value).

    Equal rows are counted where they are read, so a determinant that a third of all rows have is as many rows as it
    has combinations.
    """
    return _agreed(df, determinant, attributes).drop("_kinds")


def _agreed(df: DataFrame, determinant: tuple[str, ...], attributes: list[str]) -> DataFrame:
    """The same with _kinds, the number of combinations that the determinant has."""
    both = [*determinant, *attributes]
    counts = df.where(_no_null(determinant)).groupBy(*map(_q, both)).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*map(_q, determinant)).agg(F.max(F.struct("_n", *map(_q, attributes))).alias("_best"), F.count("*").alias("_kinds"))
    return best.select(*map(_q, determinant), *[F.col(f"_best.`{a}`").alias(a) for a in attributes], "_kinds")


def _deviating(df: DataFrame, best: DataFrame, determinant: tuple[str, ...], attributes: list[str], columns: list[str]) -> DataFrame:
    """columns of the rows that don't have their determinant's combination; with a null in the determinant, of those
    with any attribute.

    Only rows of determinants with several combinations can deviate, so only these meet the combinations; where such
    determinants are few, their rows are told where they are read.
    """
    odd = best.where("_kinds > 1").drop("_kinds")
    known = df.where(_no_null(determinant))
    if odd.count() <= FEW_ODD:
        known = known.join(F.broadcast(odd.select(*map(_q, determinant))), list(determinant), "left_semi")
    renamed = [f"_agreed_{a}" for a in attributes]
    facts = odd.select(*map(_q, determinant), F.lit(True).alias("_odd"), *[_q(a).alias(r) for a, r in zip(attributes, renamed, strict=True)])
    beside = spread_join(known, facts, [(c, c) for c in determinant], ["_odd", *renamed])
    differs = ~_all(_q(a).eqNullSafe(_q(r)) for a, r in zip(attributes, renamed, strict=True))
    unknown = df.where(~_no_null(determinant) & ~_all(_q(a).isNull() for a in attributes))
    return beside.where(F.col("_odd") & differs).select(*map(_q, columns)).unionByName(unknown.select(*map(_q, columns)))


def violations(df: DataFrame, determinant: tuple[str, ...], dependent: str) -> DataFrame:
    """determinant columns, n_rows, n_values (a null is one) and n_deviating (rows without the value that most rows
    have), for each group that does not agree; groups of a determinant with nulls are asked too."""
    counts = df.groupBy(*map(_q, determinant), _q(dependent)).agg(F.count("*").alias("_n"))
    groups = counts.groupBy(*map(_q, determinant)).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_values"), (F.sum("_n") - F.max("_n")).alias("n_deviating"))
    return groups.where("n_values > 1")


def spread_join(rows: DataFrame, facts: DataFrame, pairs: list[tuple[str, str]], facts_columns: list[str]) -> DataFrame:
    """rows with facts_columns of facts, joined left on pairs (column of rows, column of facts; nulls match nothing).

    facts has a row for each key at most. Keys with more than HOT_SHARE of the rows go to SALTS tasks each, as do rows
    with a null in the key, which a plain join would all send to one; only hot keys' facts are copied. The hot keys are
    counted first, and there are 1 / HOT_SHARE of them at most.
    """
    mine, theirs = [a for a, _ in pairs], [b for _, b in pairs]
    counts = rows.where(_no_null(tuple(mine))).groupBy(*map(_q, mine)).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") > max(HOT_SHARE * total, 1_000)).select(*[_q(a).alias(f"_h{i}") for i, a in enumerate(mine)], F.lit(True).alias("_hot"))
    same = lambda names: _all(_q(c) == F.col(f"_h{i}") for i, c in enumerate(names))
    drop = [f"_h{i}" for i in range(len(mine))]
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    salted = rows.withColumn("_any", salt).join(F.broadcast(hot), same(mine), "left").drop(*drop)
    salted = salted.withColumn("_salt", F.when(F.col("_hot") | ~_no_null(tuple(mine)), F.col("_any")).otherwise(0)).drop("_any", "_hot")
    copies = facts.select(*[_q(b).alias(f"_k{i}") for i, b in enumerate(theirs)], *[_q(c).alias(f"_f{i}") for i, c in enumerate(facts_columns)])
    copies = copies.join(F.broadcast(hot), _all(F.col(f"_k{i}") == F.col(f"_h{i}") for i in range(len(mine))), "left").drop(*drop)
    every = F.array(*map(F.lit, range(SALTS)))
    copies = copies.withColumn("_salt2", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    on = _all(_q(a) == F.col(f"_k{i}") for i, a in enumerate(mine)) & (F.col("_salt") == F.col("_salt2"))
    return salted.join(copies, on, "left").select(*map(_q, rows.columns), *[F.col(f"_f{i}").alias(c) for i, c in enumerate(facts_columns)])


def _all(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def split(rest: Piece, name: str, determinant: tuple[str, ...], attributes: list[str], kind: str, key: tuple[str, ...]) -> tuple[Piece, list[Piece]]:
    """(the rest without the attributes, [the determinant's table, the exceptions if there are any]).

    key: of the source, unique and without nulls; its exceptions hang on it. Without a key, a dependency that does not
    hold in every group is not split: the rest comes back as it is.
    """
    df, moved = rest.df, [a for a in attributes if a in rest.df.columns]
    if not moved:
        return rest, []
    both = saved(_agreed(df, determinant, moved), "agreed")
    best = both.drop("_kinds")
    deviating = saved(_deviating(df, both, determinant, moved, [*key, *moved] if set(key) <= set(df.columns) else moved), "deviating")
    if not deviating.isEmpty():
        if not key or not set(key) <= set(df.columns):
            return rest, []
        extra = [Piece(f"{name}_exceptions", deviating, rest.source, "exceptions", determinant, tuple(moved), key, reference(f"{name}_exceptions", key, rest.name, relationship="one-to-one"))]
    else:
        extra = []
    parent = Piece(name, best, rest.source, kind, determinant, tuple(moved), determinant, reference(rest.name, determinant, name))
    left = replace(rest, df=df.drop(*moved), attributes=tuple(c for c in rest.attributes if c not in moved))
    return left, [parent, *extra]


def rebuilt(found: Decomposition) -> DataFrame:
    """The source's rows from its pieces: parts and entities joined back to what refers to them, last split first;
    exceptions override. Lists of values (1NF) are no part of it.

    Each join but the last is written, as the next one reads it several times."""
    frames = {p.name: p.df for p in found.pieces}
    odd = {(p.reference.pk_table, p.determinant, p.attributes): p for p in found.splits if p.kind == "exceptions"}
    joined = [p for p in found.splits if p.kind in ("part", "entity")]
    for p in reversed(joined):
        home, moved = p.reference.fk_table, [c for c in frames[p.name].columns if c not in p.determinant]
        df = spread_join(frames[home], frames[p.name], list(zip(p.reference.columns, p.reference.targets, strict=True)), moved)
        e = next((e for (at, x, a), e in odd.items() if (at, x) == (home, p.determinant) and set(a) == set(moved)), None)
        if e:
            other = e.df.select(*[_q(k).alias(f"_k{i}") for i, k in enumerate(e.key)], *[_q(a).alias(f"_e{i}") for i, a in enumerate(e.attributes)], F.lit(True).alias("_odd"))
            df = df.join(other, _all(_q(k) == F.col(f"_k{i}") for i, k in enumerate(e.key)), "left")
            made = {a: F.when(F.col("_odd"), F.col(f"_e{i}")).otherwise(_q(a)) for i, a in enumerate(e.attributes)}
            df = df.withColumns(made).drop("_odd", *[f"_k{i}" for i in range(len(e.key))], *[f"_e{i}" for i in range(len(e.attributes))])
        frames[home] = saved(df, "rebuilt") if p is not joined[0] else df
    return frames[found.rest.name]


def translate(parent: Piece, surrogate: DataFrame, column: str, children: list[tuple[str, DataFrame, ForeignKey]]) -> dict[str, tuple[DataFrame, ForeignKey]]:
    """The children of a parent that got a surrogate key: its column takes the place of those that referred to the
    parent's natural key, and the reference follows. surrogate: the parent with the new column.

    A child's row whose reference is null, or meets no parent, has a null there.
    """
    out = {}
    for name, df, old in children:
        fresh, k = column, 0
        while fresh in df.columns:
            k += 1
            fresh = f"{column}_{k}"
        facts = surrogate.select(*map(_q, old.targets), _q(column).alias(fresh))
        joined = spread_join(df, facts, list(zip(old.columns, old.targets, strict=True)), [fresh])
        kept = [c for c in df.columns if c not in old.columns]
        out[name] = (joined.select(*map(_q, [*kept, fresh])), ForeignKey(name, fresh, old.pk_table, column, old.relationship, "surrogate"))
    return out


def coverage(tables: dict[str, DataFrame], references: list[ForeignKey]) -> DataFrame:
    """child, columns, parent, n_values (different keys without nulls), n_missing and coverage of references of any
    number of columns, and n_repeated (keys of the parent that occur more than once: a reference needs 0)."""
    out = None
    for r in references:
        child = tables[r.fk_table].where(_no_null(r.columns)).select(*[_q(c).alias(f"k{i}") for i, c in enumerate(r.columns)]).distinct().select("*", F.lit(1).alias("asked"), F.lit(0).cast("long").alias("held"))
        parent = tables[r.pk_table].groupBy(*[_q(c).alias(f"k{i}") for i, c in enumerate(r.targets)]).agg(F.count("*").alias("held")).select(*[f"k{i}" for i in range(len(r.targets))], F.lit(0).alias("asked"), "held")
        votes = child.unionByName(parent).groupBy(*[f"k{i}" for i in range(len(r.columns))]).agg(F.max("asked").alias("asked"), F.max("held").alias("held"))
        part = votes.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("n_values"), F.count(F.when((F.col("asked") == 1) & (F.col("held") == 0), 1)).alias("n_missing"), F.count(F.when(F.col("held") > 1, 1)).alias("n_repeated"))
        part = part.select(F.lit(r.fk_table).alias("child"), F.lit("+".join(r.columns)).alias("columns"), F.lit(r.pk_table).alias("parent"), "n_values", "n_missing", F.when(F.col("n_values") > 0, 1 - F.col("n_missing") / F.col("n_values")).otherwise(F.lit(1.0)).alias("coverage"), "n_repeated")
        out = part if out is None else out.unionByName(part)
    return out

