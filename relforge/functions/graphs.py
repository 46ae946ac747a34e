"""Small directed graphs of tables, on the driver."""

from __future__ import annotations

from collections.abc import Iterable


def reaches(edges: Iterable[tuple[str, str]], start: str, goal: str) -> bool:
    """Whether goal can be reached from start along one edge or more."""
    after: dict[str, set[str]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    seen, todo = set(), list(after.get(start, ()))
    while todo:
        node = todo.pop()
        if node == goal:
            return True
        if node not in seen:
            seen.add(node)
            todo += after.get(node, ())
    return False


def closes_cycle(edges: Iterable[tuple[str, str]], child: str, parent: str, allow_self: bool = False) -> bool:
    """Whether child -> parent would complete a cycle among the edges."""
    if child == parent:
        return not allow_self
    return reaches(edges, parent, child)


def ordered(nodes: Iterable[str], edges: Iterable[tuple[str, str]]) -> list[str]:
    """Nodes with referenced ones first; ties and cycles in the given order."""
    nodes, edges = list(nodes), [(a, b) for a, b in edges if a != b]
    out: list[str] = []
    while len(out) < len(nodes):
        free = [n for n in nodes if n not in out and all(b in out or b not in nodes for a, b in edges if a == n)]
        out.append(free[0] if free else next(n for n in nodes if n not in out))
    return out
