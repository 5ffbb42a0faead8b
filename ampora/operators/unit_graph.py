"""Unit conversions as a graph of affine edges.

A node is a unit, an edge ``(a, b, scale, offset)`` says ``x a = scale * x + offset b``. Every edge can be
walked both ways. ``compositions`` walks the graph breadth first from each canonical target, so that each unit
gets the shortest chain of edges, composed into one affine function with exact fractions; ``check_cycles``
proves that every other chain says the same. The resulting table is small (one row per unit), fixed and joined on
the unit.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass
from fractions import Fraction


@dataclass(frozen=True)
class Edge:
    """``x`` in ``source`` is ``scale * x + offset`` in ``target``."""

    source: str
    target: str
    scale: Fraction
    offset: Fraction = Fraction(0)


def edge(source: str, target: str, scale: str | int | Fraction, offset: str | int | Fraction = 0) -> Edge:
    return Edge(source, target, Fraction(scale), Fraction(offset))


class UnitGraph:
    """A set of conversion edges."""

    def __init__(self, edges: list[Edge]):
        self.edges = list(edges)
        self._out: dict[str, list[tuple[str, Fraction, Fraction]]] = defaultdict(list)
        for e in self.edges:
            if e.scale == 0:
                raise ValueError(f"{e.source} -> {e.target} cannot be inverted")
            self._out[e.source].append((e.target, e.scale, e.offset))
            self._out[e.target].append((e.source, 1 / e.scale, -e.offset / e.scale))

    def from_node(self, start: str) -> dict[str, tuple[Fraction, Fraction, int]]:
        """For each reachable unit the affine function from ``start`` and the number of edges."""
        best = {start: (Fraction(1), Fraction(0), 0)}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            a, b, hops = best[at]
            for to, scale, offset in self._out[at]:
                if to not in best:
                    best[to] = (scale * a, scale * b + offset, hops + 1)
                    queue.append(to)
        return best

    def compositions(self, targets: list[str]) -> list[tuple[str, str, Fraction, Fraction, int]]:
        """Rows ``(unit, target, scale, offset, hops)``; a unit that reaches two targets is an error."""
        rows, owner = [], {}
        for target in targets:
            for unit, (a, b, hops) in self.from_node(target).items():
                if unit in owner:
                    raise ValueError(f"{unit} reaches both {owner[unit]} and {target}")
                owner[unit] = target
                rows.append((unit, target, 1 / a, -b / a, hops))
        return rows

    def check_cycles(self, targets: list[str]) -> None:
        """Raises ValueError where two chains between the same units disagree."""
        for target in targets:
            best = self.from_node(target)
            for e in self.edges:
                if e.source in best:
                    a, b, _ = best[e.source]
                    c, d, _ = best[e.target]
                    if (e.scale * a, e.scale * b + e.offset) != (c, d):
                        raise ValueError(f"cycle through {e.source} -> {e.target} is not consistent")
