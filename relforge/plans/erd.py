"""Entity-relationship diagrams as DOT and Mermaid text."""

from __future__ import annotations

import re

from relforge.operators.foreign_keys import ForeignKey


def edges(foreign: list[ForeignKey]) -> list[tuple[str, str, str]]:
    """(child, parent, label)."""
    return [(k.fk_table, k.pk_table, f"{', '.join(k.columns)} → {', '.join(k.targets)}") for k in foreign]


def dot(columns: dict[str, list[str]], keys: dict[str, tuple[str, ...]], foreign: list[ForeignKey]) -> str:
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    field = lambda s: re.sub(r"([\\{}|<>\" ])", r"\\\1", s)
    lines = ["digraph schema {", "    rankdir=TB;", "    node [shape=record];"]
    for t, names in sorted(columns.items()):
        rows = "\\l".join(("* " if c in keys.get(t, ()) else "  ") + field(c) for c in names)
        lines.append(f'    {quote(t)} [label="{{{field(t)}|{rows}\\l}}"];')
    lines += [f"    {quote(a)} -> {quote(b)} [label={quote(label)}];" for a, b, label in edges(foreign)]
    return "\n".join([*lines, "}"]) + "\n"


def mermaid(types: dict[str, list[tuple[str, str]]], keys: dict[str, tuple[str, ...]], foreign: list[ForeignKey]) -> str:
    """types: table -> (column, simple type)."""
    plain = lambda s: re.sub(r"\W", "_", s)
    lines = ["erDiagram"]
    refs = {(k.fk_table, c) for k in foreign for c in k.columns}
    for t, columns in sorted(types.items()):
        lines.append(f"    {plain(t)} {{")
        lines += [f"        {kind} {plain(c)}{' PK' if c in keys.get(t, ()) else ' FK' if (t, c) in refs else ''}" for c, kind in columns]
        lines.append("    }")
    lines += [f"    {plain(k.pk_table)} ||--o{{ {plain(k.fk_table)} : {plain('_'.join(k.columns))}" for k in foreign]
    return "\n".join(lines) + "\n"


def simple_type(spark_type: str) -> str:
    """int, float, date or string."""
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return "float"
    return "date" if spark_type.startswith(("date", "timestamp")) else "string"
