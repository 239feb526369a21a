"""One factor graph in memory: cardinalities and factor tables with an axis per variable."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Joint states that full enumeration may visit.
MAX_STATES = 1 << 22


def lse(x: np.ndarray, axis=None) -> np.ndarray:
    """log sum exp, shifted by the maximum."""
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out.reshape(()) if axis is None else np.squeeze(out, axis=axis)


@dataclass
class Graph:
    """cards: number of states of each variable. factors: (variables, energy table with one axis per variable)."""

    cards: list[int]
    factors: list[tuple[tuple[int, ...], np.ndarray]]

    @classmethod
    def of(cls, cards: Iterable[int], factors: Iterable[tuple[Iterable[int], Iterable[float]]]) -> Graph:
        """Tables come as lists with the first variable fastest."""
        cards = [int(c) for c in cards]
        made = []
        for scope, table in factors:
            scope = tuple(int(v) for v in scope)
            if len(set(scope)) != len(scope):
                raise ValueError(f"a factor names a variable twice: {scope}")
            made.append((scope, np.asarray(list(table), dtype=float).reshape([cards[v] for v in scope], order="F")))
        return cls(cards, made)

    @cached_property
    def touching(self) -> list[list[int]]:
        """The factors of each variable."""
        out: list[list[int]] = [[] for _ in self.cards]
        for k, (scope, _) in enumerate(self.factors):
            for v in scope:
                out[v].append(k)
        return out

    def energy(self, state) -> float:
        return float(sum(table[tuple(state[v] for v in scope)] for scope, table in self.factors))

    def site(self, v: int, state) -> np.ndarray:
        """Energy of each state of v, of the factors that touch it, the others fixed."""
        out = np.zeros(self.cards[v])
        for k in self.touching[v]:
            scope, table = self.factors[k]
            out += table[tuple(slice(None) if u == v else state[u] for u in scope)]
        return out

    def spread(self, k: int, values: np.ndarray, v: int) -> np.ndarray:
        """A vector over v's states as an array that broadcasts over factor k's table."""
        scope = self.factors[k][0]
        return values.reshape([-1 if u == v else 1 for u in scope])

    def joint(self) -> np.ndarray:
        """Energies of all joint states, one axis per variable."""
        if np.prod([float(c) for c in self.cards]) > MAX_STATES:
            raise ValueError("too many joint states to enumerate")
        total = np.zeros(self.cards)
        for scope, table in self.factors:
            order = np.argsort(scope)
            shape = [self.cards[v] if v in scope else 1 for v in range(len(self.cards))]
            total = total + table.transpose(order).reshape(shape)
        return total

    def components(self, left_out: set[int] = frozenset()) -> list[int]:
        """The smallest variable that each variable is connected to, without the factors left out."""
        label = list(range(len(self.cards)))

        def root(v: int) -> int:
            while label[v] != v:
                label[v] = label[label[v]]
                v = label[v]
            return v

        for k, (scope, _) in enumerate(self.factors):
            if k not in left_out:
                for v in scope[1:]:
                    a, b = root(scope[0]), root(v)
                    label[max(a, b)] = min(a, b)
        return [root(v) for v in range(len(self.cards))]

    def is_forest(self) -> bool:
        """No cycle: as many links as a spanning forest has."""
        links = sum(len(scope) - 1 for scope, _ in self.factors)
        return links == len(self.cards) - len(set(self.components()))

    def with_tables(self, tables: list[np.ndarray]) -> Graph:
        return Graph(self.cards, [(scope, t) for (scope, _), t in zip(self.factors, tables)])


@dataclass
class Result:
    """Marginals of each factor (tables shaped as the factors') and log Z, None where a method has none."""

    marginals: list[np.ndarray]
    log_z: float | None

    def entropy(self, graph: Graph) -> float | None:
        """log Z plus expected energy."""
        if self.log_z is None:
            return None
        return self.log_z + sum(float((m * t).sum()) for m, (_, t) in zip(self.marginals, graph.factors))
