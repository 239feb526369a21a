"""Exact inference: enumeration, and message passing on forests."""

from __future__ import annotations

import numpy as np

from .graph import Graph, Result, lse


def _others(graph: Graph, scope: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(v for v in range(len(graph.cards)) if v not in scope)


def enumerate_all(graph: Graph) -> Result:
    """Marginals and log Z from all joint states."""
    score = -graph.joint()
    log_z = float(lse(score))
    p = np.exp(score - log_z)
    out = []
    for scope, _ in graph.factors:
        m = p.sum(axis=_others(graph, scope))
        rank = np.argsort(np.argsort(scope))
        out.append(m.transpose(rank) if len(scope) > 1 else m)
    return Result(out, log_z)


def enumerate_map(graph: Graph) -> tuple[list[int], float]:
    """The state of least energy; of equals the first with variable 0 running fastest."""
    joint = graph.joint()
    at = int(np.argmin(joint.ravel(order="F")))
    state = np.unravel_index(at, joint.shape, order="F")
    return [int(s) for s in state], float(joint[state])


class Forest:
    """Two passes of messages over a forest of factors; `summed` is log-sum-exp or max."""

    def __init__(self, graph: Graph):
        if not graph.is_forest():
            raise ValueError("the graph has a cycle")
        self.graph = graph
        self.order: list[tuple[int, int]] = []  # (factor, its variable next to the root), roots first
        self.roots: list[int] = []
        seen_v, seen_f = set(), set()
        for start in range(len(graph.cards)):
            if start in seen_v:
                continue
            self.roots.append(start)
            seen_v.add(start)
            line = [start]
            for v in line:
                for k in graph.touching[v]:
                    if k not in seen_f:
                        seen_f.add(k)
                        self.order.append((k, v))
                        new = [u for u in graph.factors[k][0] if u != v]
                        seen_v.update(new)
                        line += new

    def upward(self, maximum: bool = False) -> float:
        """Messages towards the roots. Returns log Z, or the greatest score."""
        g = self.graph
        self.to_var: dict[int, np.ndarray] = {}
        self.below = [np.zeros(c) for c in g.cards]
        for k, v in reversed(self.order):
            scope, table = g.factors[k]
            score = -table
            for u in scope:
                if u != v:
                    score = score + g.spread(k, self.below[u], u)
            axes = tuple(i for i, u in enumerate(scope) if u != v)
            message = score if not axes else score.max(axis=axes) if maximum else lse(score, axes)
            self.to_var[k] = message
            self.below[v] = self.below[v] + message
        return float(sum(self.below[r].max() if maximum else lse(self.below[r]) for r in self.roots))

    def infer(self) -> Result:
        g, log_z = self.graph, self.upward()
        above = [np.zeros(c) for c in g.cards]
        out: list[np.ndarray] = [np.zeros(0)] * len(g.factors)
        for k, v in self.order:
            scope, table = g.factors[k]
            rest = above[v] + self.below[v] - self.to_var[k]
            score = -table + g.spread(k, rest, v)
            for u in scope:
                if u != v:
                    score = score + g.spread(k, self.below[u], u)
            out[k] = np.exp(score - lse(score))
            for i, u in enumerate(scope):
                if u != v:
                    axes = tuple(j for j in range(len(scope)) if j != i)
                    above[u] = lse(score, axes) - self.below[u]
        return Result(out, log_z)

    def _walk(self, pick) -> list[int]:
        g, state = self.graph, [0] * len(self.graph.cards)
        for r in self.roots:
            state[r] = pick(self.below[r])
        for k, v in self.order:
            scope, table = g.factors[k]
            score = -table
            for u in scope:
                if u != v:
                    score = score + g.spread(k, self.below[u], u)
            free = [u for u in scope if u != v]
            if free:
                score = score[tuple(state[v] if u == v else slice(None) for u in scope)]
                at = np.unravel_index(pick(score.ravel(order="F")), score.shape, order="F")
                for u, s in zip(free, at):
                    state[u] = int(s)
        return state

    def map(self) -> tuple[list[int], float]:
        self.upward(maximum=True)
        state = self._walk(lambda s: int(np.argmax(s)))
        return state, self.graph.energy(state)

    def sample(self, n: int, rng: np.random.Generator) -> np.ndarray:
        """n exact samples, each drawn from the roots outwards."""
        self.upward()

        def draw(score: np.ndarray) -> int:
            return int(np.searchsorted(np.cumsum(np.exp(score - lse(score))), rng.random() * (1 - 1e-12)))

        return np.array([self._walk(draw) for _ in range(n)], dtype=int).reshape(n, len(self.graph.cards))
