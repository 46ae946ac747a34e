"""Foreign keys: inclusion dependencies counted in Spark, accepted by rules on names, sizes and cycles."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from relforge.functions import graphs, naming
from relforge.functions.hashing import wide_hash
from relforge.sources.catalog import plain

from .dependencies import TableFacts


@dataclass(frozen=True)
class ForeignKey:
    fk_table: str
    fk_column: str
    pk_table: str
    pk_column: str
    relationship: str = "many-to-one"
    reason: str = "included"
    #: Further (child, parent) columns of a reference to a composite key.
    more: tuple[tuple[str, str], ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.fk_column, *[a for a, _ in self.more])

    @property
    def targets(self) -> tuple[str, ...]:
        return (self.pk_column, *[b for _, b in self.more])


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


#: Sides of a reference: (table, its columns).
Side = tuple[str, tuple[str, ...]]
#: One in so many values, by their hash, is looked at first to refute inclusions.
FIRST_LOOK = 64


def tuple_inclusion(tables: dict[str, DataFrame], pairs: list[tuple[Side, Side]], one_in: int = 1) -> DataFrame:
    """pair (its place in the list), n_values (different tuples of the child without a null, as text) and n_missing
    (those that the parent has not).

    All sides become one table of (side, 128-bit hash of the tuple), which is grouped by hash once; a tuple's sides
    then vote for the pairs. A set of sides is bounded by their number, not by rows. With one_in, only tuples whose
    hash is a multiple of it move; both sides keep the same ones, so what is missing among them is missing in all.
    """
    sides = sorted({s for p in pairs for s in p})
    number = {s: i for i, s in enumerate(sides)}
    long = None
    for (t, columns), i in number.items():
        rows = plain(tables[t].select(*map(_q, columns)))
        for c in columns:
            rows = rows.where(_q(c).isNotNull())
        part = rows.select(F.lit(i).alias("side"), *wide_hash([_q(c).cast("string") for c in columns]))
        part = (part.where(F.pmod("g0", F.lit(one_in)) == 0) if one_in > 1 else part).distinct()
        long = part if long is None else long.unionByName(part)
    sets = long.groupBy("g0", "g1").agg(F.collect_set("side").alias("sides")).groupBy("sides").agg(F.count("*").alias("n"))
    has = lambda s: F.array_contains("sides", number[s])
    tests = F.array(*[F.struct(F.lit(i).alias("pair"), F.when(has(a), F.col("n")).otherwise(0).alias("child"), F.when(has(a) & ~has(b), F.col("n")).otherwise(0).alias("missing")) for i, (a, b) in enumerate(pairs)])
    votes = sets.select(F.explode(tests).alias("v")).select("v.*").groupBy("pair").agg(F.sum("child").alias("n_values"), F.sum("missing").alias("n_missing"))
    return votes


def inclusion(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """fk_table, fk_column, pk_table, pk_column, n_values (distinct, as text), n_missing (not among the parent's),
    for each of the pairs; none for a pair of empty columns only. See ``tuple_inclusion``."""
    votes = tuple_inclusion(tables, [((a, (b,)), (x, (y,))) for a, b, x, y in pairs])
    names = tables[pairs[0][0]].sparkSession.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair int, fk_table string, fk_column string, pk_table string, pk_column string")
    return votes.join(F.broadcast(names), "pair").select("fk_table", "fk_column", "pk_table", "pk_column", "n_values", "n_missing")


def refuted(tables: dict[str, DataFrame], pairs: list[tuple[Side, Side]], one_in: int = FIRST_LOOK) -> set[int]:
    """Places of pairs that are no inclusion, told from one in `one_in` values: none that holds is among them."""
    return {r["pair"] for r in tuple_inclusion(tables, pairs, one_in).where("n_missing > 0").collect()} if pairs else set()


def _counted(tables: dict[str, DataFrame], pairs: list[tuple[Side, Side]]) -> list[tuple[int, int]]:
    """(n_values, n_missing) for each pair; of a pair that the first look refutes only that something is missing."""
    found: list[tuple[int, int]] = []
    for at in range(0, len(pairs), 200):
        part = pairs[at : at + 200]
        out = refuted(tables, part)
        left = [p for i, p in enumerate(part) if i not in out]
        counts = {r["pair"]: (r["n_values"], r["n_missing"]) for r in tuple_inclusion(tables, left).collect()} if left else {}
        rest = iter(counts.get(i, (0, 0)) for i in range(len(left)))
        found += [(1, 1) if i in out else next(rest) for i in range(len(part))]
    return found


def _measured(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> dict[tuple[str, str, str, str], tuple[int, int]]:
    return dict(zip(pairs, _counted(tables, [((a, (b,)), (x, (y,))) for a, b, x, y in pairs]), strict=True))


def candidate_pairs(facts: dict[str, TableFacts]) -> list[tuple[str, str, str, str]]:
    """Pairs that pass the rules on names and keys: the parent has a single-column key, the child's column is not
    in its own key and is named like a reference."""
    parents = [(t, f.primary_key[0]) for t, f in sorted(facts.items()) if len(f.primary_key) == 1]
    return [(t, c, p, k) for t, f in sorted(facts.items()) for c in f.columns if c not in f.primary_key and naming.foreign_key_name(c) for p, k in parents if p != t]


def hierarchy_pairs(facts: dict[str, TableFacts]) -> list[tuple[str, str, str, str]]:
    """Columns that may point to the key of their own table."""
    out = []
    for t, f in sorted(facts.items()):
        if len(f.primary_key) != 1:
            continue
        key = f.primary_key[0]
        entity = re.sub(r"_id$", "", key, flags=re.I)
        out += [(t, c, t, key) for c in f.columns if c != key and (naming.hierarchical(c, t) or (entity != key and c.lower() == f"parent_{entity}_id".lower()))]
    return out


def detect(tables: dict[str, DataFrame], facts: dict[str, TableFacts], require_parent_le_child: bool = True) -> list[ForeignKey]:
    """Foreign keys over all tables.

    A pair needs every non-null value of the child among the parent's (at least one), a parent with no more rows
    than the child unless that rule is off, and must close no cycle. A column with several such parents goes to
    the one that its name fits; if none does, it is left out. Tables and columns are taken by name, so the result
    does not depend on the order of the catalog.
    """
    measured = _measured(tables, candidate_pairs(facts))
    self_pairs = hierarchy_pairs(facts)
    found: list[ForeignKey] = []
    edges: list[tuple[str, str]] = []
    for t, f in sorted(facts.items()):
        for c in f.columns:
            fits = []
            for (a, b, p, k), (n, missing) in sorted(measured.items()):
                if (a, b) != (t, c) or not n or missing:
                    continue
                if require_parent_le_child and facts[p].n_rows > f.n_rows:
                    continue
                if not graphs.closes_cycle(edges, t, p):
                    fits.append((p, k))
            parent = fits[0][0] if len(fits) == 1 else naming.matching_parent(c, [p for p, _ in fits])
            if parent is None:
                continue
            edges.append((t, parent))
            found.append(ForeignKey(t, c, parent, dict(fits)[parent], "one-to-one" if f.is_unique(c) else "many-to-one", "only parent" if len(fits) == 1 else "name"))
    taken = {(k.fk_table, k.fk_column) for k in found}
    for pair, (n, missing) in sorted(_measured(tables, self_pairs).items()) if self_pairs else []:
        if n and not missing and pair[:2] not in taken:
            found.append(ForeignKey(*pair, "hierarchy", "own table"))
    return found


def infer_by_name(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]], known: list[ForeignKey], key_parts: bool = False) -> list[ForeignKey]:
    """Further keys from names alone: <entity>_id to a table called entity, entitys or entityes with a single
    key, if all values are there and no cycle closes. Columns of a table's own key are left out, but with key_parts
    those of a composite key may refer to another table."""
    taken, edges = {(k.fk_table, k.fk_column) for k in known if not k.more}, [(k.fk_table, k.pk_table) for k in known]
    pairs = []
    for t, df in sorted(tables.items()):
        for c in df.columns:
            if not c.lower().endswith("_id") or (c in keys.get(t, ()) and not (key_parts and len(keys[t]) > 1)) or (t, c) in taken:
                continue
            base = c[:-3].lower()
            pairs += [(t, c, p, keys[p][0]) for p in sorted(tables) if p != t and p.lower() in (base, f"{base}s", f"{base}es") and len(keys.get(p, ())) == 1][:1]
    out = []
    for pair, (n, missing) in sorted(_measured(tables, pairs).items()) if pairs else []:
        if n and not missing and not graphs.closes_cycle(edges, pair[0], pair[2]):
            edges.append((pair[0], pair[2]))
            out.append(ForeignKey(*pair, "many-to-one", "inferred from the name"))
    return out


def composite(tables: dict[str, DataFrame], facts: dict[str, TableFacts], known: list[ForeignKey] = ()) -> list[ForeignKey]:
    """References of several columns to composite keys.

    Level by level: a column of a child is a candidate for a column of the key if it is called like it or named like a
    reference, is not the child's own key, and if its values are all there (those in rows with a null elsewhere too); these are joined to pairs and, for larger keys, to triples and so on,
    each tested as tuples, and only what holds goes on. Rows with a null in the columns are not asked. Of several
    column choices for one key the one that shares most names with it counts, then the first in the child's order.
    A child's columns must differ; a reference that closes a cycle with the known ones is left out.
    """
    out: list[ForeignKey] = []
    edges = [(k.fk_table, k.pk_table) for k in known]
    for p, f in sorted(facts.items()):
        key = f.primary_key
        if len(key) < 2:
            continue
        for t in sorted(facts):
            if t == p:
                continue
            fits = lambda c, k: (c,) != facts[t].primary_key and (c.lower() == k.lower() or naming.foreign_key_name(c))
            level = [((c,), (k,)) for k in key for c in facts[t].columns if fits(c, k) and _kind(tables[t], c) == _kind(tables[p], k)]
            held = {x for x, (n, missing) in zip(level, _counted(tables, [((t, a), (p, b)) for a, b in level]), strict=True) if n and not missing} if {b[0] for _, b in level} == set(key) else set()
            ways = [x for x in level if x in held and x[1] == key[:1]]
            for k in key[1:]:
                wider = [((*a, c), (*b, k)) for a, b in ways for (c,), (j,) in level if ((c,), (j,)) in held and j == k and c not in a]
                ways = [x for x, (n, missing) in zip(wider, _counted(tables, [((t, a), (p, b)) for a, b in wider]), strict=True) if n and not missing]
            if ways and not graphs.closes_cycle(edges, t, p):
                place = facts[t].columns.index
                a, b = min(ways, key=lambda w: (-sum(x.lower() == y.lower() for x, y in zip(*w, strict=True)), [place(x) for x in w[0]]))
                edges.append((t, p))
                out.append(ForeignKey(t, a[0], p, b[0], "one-to-one" if set(a) == set(facts[t].primary_key) else "many-to-one", "composite", tuple(zip(a[1:], b[1:], strict=True))))
    return out


def _kind(df: DataFrame, column: str) -> str:
    """number, text or the type itself."""
    kind = df.schema[column].dataType
    return "number" if isinstance(kind, NumericType) else kind.simpleString()


def compatible(a: str, b: str) -> bool:
    """Whether two DDL types belong to one family: numbers, texts or times."""
    family = lambda t: next((k for k, words in (("number", ("NUMBER", "INT")), ("text", ("CHAR",)), ("time", ("DATE", "TIMESTAMP"))) if any(w in t.upper() for w in words)), t.upper())
    return family(a) == family(b)


def summary(keys: list[ForeignKey]) -> str:
    return "\n".join([f"{len(keys)} foreign keys", *[f"{k.fk_table}.{k.fk_column} -> {k.pk_table}.{k.pk_column} ({k.relationship}, {k.reason})" for k in keys]])
