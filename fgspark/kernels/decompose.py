"""Decompositions of one graph: induced forests, set packing, Eulerian trails; and random trees to test with."""

from __future__ import annotations

import numpy as np

from .graph import Graph


def _wide(graph: Graph) -> list[int]:
    return [k for k, (scope, _) in enumerate(graph.factors) if len(scope) > 1]


def _links(graph: Graph, label: list[int], sides: set[int]) -> list[int]:
    """Factors that touch more than one of the components `sides`."""
    return [k for k in _wide(graph) if len({label[v] for v in graph.factors[k][0]} & sides) > 1]


def acyclic_greedy(graph: Graph, weights: list[float]) -> set[int]:
    """Factors to leave out so that each component is a tree and no left-out factor lies in one.

    Heaviest first, a factor is kept if it is the only one between the components it touches.
    """
    out = set(_wide(graph))
    for k in sorted(out, key=lambda k: (-weights[k], k)):
        label = graph.components(out)
        sides = {label[v] for v in graph.factors[k][0]}
        if len(sides) == len(graph.factors[k][0]) and _links(graph, label, sides) == [k]:
            out.discard(k)
    return out


def acyclic_annealed(graph: Graph, weights: list[float], steps: int = 2000, start: float = 5.0, end: float = 0.1, seed: int = 0) -> set[int]:
    """As acyclic_greedy(), by annealing over which factors are kept; never worse than greedy."""
    rng, out = np.random.default_rng(seed), acyclic_greedy(graph, weights)
    best, wide = set(out), _wide(graph)
    value = lambda s: sum(weights[k] for k in wide if k not in s)
    for t in np.geomspace(start, end, steps):
        k = wide[int(rng.integers(len(wide)))]
        if k in out:
            label = graph.components(out)
            sides = {label[v] for v in graph.factors[k][0]}
            if len(sides) == len(graph.factors[k][0]) and _links(graph, label, sides) == [k]:
                out.discard(k)
        elif rng.random() < np.exp(-weights[k] / t):
            out.add(k)
        if value(out) > value(best):
            best = set(out)
    return best


class UndoSets:
    """Disjoint sets whose unions can be taken back, the last first. Paths stay as they are, so finding takes log n steps."""

    def __init__(self, n: int):
        self.parent, self.size, self.count, self.past = list(range(n)), [1] * n, n, []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        """Whether the two were apart; either way it can be undone."""
        x, y = self.find(x), self.find(y)
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.past.append((x, y))
        if x == y:
            return False
        self.parent[y] = x
        self.size[x] += self.size[y]
        self.count -= 1
        return True

    def undo(self) -> None:
        x, y = self.past.pop()
        if x != y:
            self.parent[y] = y
            self.size[x] -= self.size[y]
            self.count += 1


def acyclic_exact(graph: Graph, weights: list[float], epsilon: float = 0.0) -> set[int]:
    """As acyclic_greedy(), of the greatest kept weight, or at most epsilon below it: each factor in turn is kept or left
    out, with a bound on the rest."""
    order = sorted(_wide(graph), key=lambda k: -weights[k])
    best = acyclic_greedy(graph, weights)
    score = sum(weights[k] for k in order if k not in best)
    spare = [0.0]
    for k in reversed(order):
        spare.append(spare[-1] + max(weights[k], 0.0))
    spare.reverse()
    sets = UndoSets(len(graph.cards))

    def search(i: int, out: set[int], kept: float) -> None:
        nonlocal best, score
        if kept > score + 1e-12:
            best, score = out | set(order[i:]), kept
        most = sum(weights[k] for k in order[i : i + sets.count - 1])  # a kept factor joins two components
        if i == len(order) or kept + min(spare[i], most) <= score + epsilon + 1e-12:
            return
        k = order[i]
        scope = graph.factors[k][0]
        label = [sets.find(v) for v in range(len(graph.cards))]
        sides = {label[v] for v in scope}
        if len(sides) == len(scope) and _links(graph, label, sides) == [k]:
            for v in scope[1:]:
                sets.union(scope[0], v)
            search(i + 1, out, kept + weights[k])
            for _ in scope[1:]:
                sets.undo()
        search(i + 1, out | {k}, kept)

    search(0, set(), 0.0)
    return best


def set_packing(sets: list[set[int]], weights: list[float], max_iter: int = 200, tol: float = 1e-9) -> tuple[list[bool], float, float]:
    """Disjoint sets of great total weight: (chosen, weight, bound on any choice's weight).

    Prices of the elements relax that each is taken once; at given prices each set stands for itself, which bounds the
    weight. Prices move along the over- and under-use, by a step towards the best choice known (Polyak); each round's
    sets are made disjoint in order of what they are worth after prices, and filled up by the others.
    """
    elements = sorted(set().union(*sets)) if sets else []
    price = dict.fromkeys(elements, 0.0)
    best: tuple[float, list[bool]] = (0.0, [False] * len(sets))
    bound = np.inf
    for k in range(max_iter):
        worth = [w - sum(price[e] for e in s) for s, w in zip(sets, weights)]
        used, chosen = set(), [False] * len(sets)
        for j in sorted(range(len(sets)), key=lambda j: (-worth[j], j)):
            if weights[j] > 0 and not sets[j] & used:
                chosen[j] = True
                used |= sets[j]
        best = max(best, (sum(w for w, c in zip(weights, chosen) if c), chosen), key=lambda x: x[0])
        dual = sum(max(w, 0.0) for w in worth) + sum(price.values())
        bound = min(bound, dual)
        if bound - best[0] <= tol * max(1.0, bound):
            break
        slope = {e: 1.0 for e in elements}
        for s, w in zip(sets, worth):
            for e in s if w > 0 else ():
                slope[e] -= 1
        norm = sum(g * g for e, g in slope.items() if g < 0 or price[e] > 0)
        if not norm:
            break
        step = (dual - best[0]) / norm / (1 + k / 50)
        price = {e: max(0.0, p - step * slope[e]) for e, p in price.items()}
    return best[1], best[0], float(min(bound, sum(max(w, 0.0) for w in weights)) if sets else 0.0)


def acyclic_packed(graph: Graph, weights: list[float]) -> set[int]:
    """As acyclic_greedy(), by rounds of set packing: of the factors that are the only one between their components, disjoint
    ones of great weight are kept and join their components, until there is none."""
    out = set(_wide(graph))
    while True:
        label = graph.components(out)
        able = []
        for k in sorted(out):
            sides = {label[v] for v in graph.factors[k][0]}
            if weights[k] > 0 and len(sides) == len(graph.factors[k][0]) and _links(graph, label, sides) == [k]:
                able.append((k, sides))
        if not able:
            return out
        chosen, _, _ = set_packing([s for _, s in able], [weights[k] for k, _ in able])
        out -= {k for (k, _), c in zip(able, chosen) if c}


def eulerian_trail(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices of a closed walk that takes each directed edge once; every vertex must have as many ins as outs."""
    ahead: dict[int, list[int]] = {}
    for a, b in reversed(edges):
        ahead.setdefault(a, []).append(b)
    if not edges:
        return []
    stack, trail = [edges[0][0]], []
    while stack:
        if ahead.get(stack[-1]):
            stack.append(ahead[stack[-1]].pop())
        else:
            trail.append(stack.pop())
    if len(trail) != len(edges) + 1:
        raise ValueError("the edges have no Eulerian circuit")
    return trail[::-1]


def message_schedule(graph: Graph, root: int = 0) -> list[tuple[int, int]]:
    """Each directed message between variables (even) and factors (odd numbers) once, along a closed walk of root's component."""
    seen, line, edges = {2 * root}, [2 * root], []
    for node in line:
        near = [2 * k + 1 for k in graph.touching[node // 2]] if node % 2 == 0 else [2 * v for v in graph.factors[node // 2][0]]
        for other in near:
            edges.append((node, other))
            if other not in seen:
                seen.add(other)
                line.append(other)
    trail = eulerian_trail(edges)
    return list(zip(trail, trail[1:]))


def random_tree(types: list[list[int]], shares: list[float], n: int, seed: int = 0) -> Graph:
    """A tree of n factors whose types (lists of cardinalities) are drawn by shares, with normal energies.

    A factor hangs on a variable of equal cardinality by one random place, its other variables are new.
    """
    rng = np.random.default_rng(seed)
    cards: list[int] = []
    factors = []
    while len(factors) < n:
        t = types[int(rng.choice(len(types), p=np.asarray(shares) / sum(shares)))]
        place = int(rng.integers(len(t)))
        fit = [v for v, c in enumerate(cards) if c == t[place]]
        if cards and not fit:
            if not any(set(x) & set(cards) for x in types):
                raise ValueError("no type fits the tree")
            continue
        hook = int(rng.choice(fit)) if cards else None
        scope = []
        for i, c in enumerate(t):
            if i == place and hook is not None:
                scope.append(hook)
            else:
                cards.append(c)
                scope.append(len(cards) - 1)
        factors.append((scope, rng.normal(size=int(np.prod(t)))))
    return Graph.of(cards, factors)
