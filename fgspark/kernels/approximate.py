"""Approximate inference by messages and coordinate ascent: loopy BP, mean field, diffusion, dual decomposition."""

from __future__ import annotations

import numpy as np

from .exact import Forest
from .graph import Graph, Result, lse


def belief_propagation(graph: Graph, max_iter: int = 100, tol: float = 1e-5, minimum: bool = False):
    """Parallel schedule. Sum-product gives Result with the Bethe log Z; min-sum the best decoded (state, energy)."""
    fv = {(k, v): np.zeros(graph.cards[v]) for k, (scope, _) in enumerate(graph.factors) for v in scope}
    vf = {key: np.zeros_like(m) for key, m in fv.items()}
    before, best = None, None
    for _ in range(max_iter or 1_000_000):
        for k, (scope, table) in enumerate(graph.factors):
            score = -table
            for v in scope:
                score = score + graph.spread(k, vf[k, v], v)
            for i, v in enumerate(scope):
                axes = tuple(j for j in range(len(scope)) if j != i)
                own = score - graph.spread(k, vf[k, v], v)
                fv[k, v] = own if not axes else own.max(axis=axes) if minimum else lse(own, axes)
        total = [sum((fv[k, v] for k in graph.touching[v]), np.zeros(graph.cards[v])) for v in range(len(graph.cards))]
        for k, v in vf:
            out = total[v] - fv[k, v]
            vf[k, v] = out - (out.mean() if minimum else lse(out))
        now = []
        for k, (scope, table) in enumerate(graph.factors):
            score = -table
            for v in scope:
                score = score + graph.spread(k, vf[k, v], v)
            now.append(np.exp(score - lse(score)))
        if minimum:
            state = [int(np.argmax(t)) for t in total]
            energy = graph.energy(state)
            if best is None or energy < best[1]:
                best = state, energy
        change = np.inf if before is None else max(float(np.abs(a - b).max()) for a, b in zip(now, before))
        before = now
        if change < tol:
            break
    if minimum:
        return best
    plogp = lambda p: float((p * np.log(np.maximum(p, 1e-300))).sum())
    beliefs = [np.exp(t - lse(t)) for t in total]
    energy = sum(float((m * t).sum()) for m, (_, t) in zip(before, graph.factors))
    entropy = -sum(plogp(m) for m in before) + sum((len(graph.touching[v]) - 1) * plogp(b) for v, b in enumerate(beliefs))
    return Result(before, entropy - energy)


def mean_field(graph: Graph, max_iter: int = 50, tol: float = 1e-6) -> Result:
    """Naive mean field: coordinate ascent on a lower bound of log Z, from the uniform distribution."""
    q = [np.full(c, 1.0 / c) for c in graph.cards]

    def expected(k: int, but: int | None) -> np.ndarray:
        scope, table = graph.factors[k]
        for i in range(len(scope) - 1, -1, -1):
            if scope[i] != but:
                table = np.tensordot(table, q[scope[i]], axes=(i, 0))
        return table

    bound = -np.inf
    for _ in range(max_iter or 1_000_000):
        for v in range(len(q)):
            score = -sum((expected(k, v) for k in graph.touching[v]), np.zeros(graph.cards[v]))
            q[v] = np.exp(score - lse(score))
        entropy = -sum(float((p * np.log(np.maximum(p, 1e-300))).sum()) for p in q)
        now = entropy - sum(float(expected(k, None)) for k in range(len(graph.factors)))
        done, bound = now - bound < tol, now
        if done:
            break
    out = []
    for k, (scope, table) in enumerate(graph.factors):
        p = np.ones_like(table)
        for v in scope:
            p = p * graph.spread(k, q[v], v)
        out.append(p)
    return Result(out, bound)


def structured_mean_field(graph: Graph, left_out: set[int], max_iter: int = 50, tol: float = 1e-6) -> Result:
    """Mean field over the components that remain without the factors left out; each component must be a forest.

    A left-out factor acts on a component through its expectation over the other variables' beliefs.
    """
    label = graph.components(left_out)
    inside: dict[int, list[int]] = {}
    for v, c in enumerate(label):
        inside.setdefault(c, []).append(v)
    q = [np.full(c, 1.0 / c) for c in graph.cards]
    results: dict[int, tuple[Result, list[int]]] = {}
    bound = -np.inf
    for _ in range(max_iter or 1_000_000):
        for c, members in inside.items():
            new = {v: i for i, v in enumerate(members)}
            own = [k for k, (scope, _) in enumerate(graph.factors) if k not in left_out and scope[0] in new]
            factors = [(tuple(new[v] for v in graph.factors[k][0]), graph.factors[k][1]) for k in own]
            fields = {v: np.zeros(graph.cards[v]) for v in members}
            for k in left_out:
                scope, table = graph.factors[k]
                free = [v for v in scope if v in new]
                for i in range(len(scope) - 1, -1, -1):
                    if scope[i] not in new:
                        table = np.tensordot(table, q[scope[i]], axes=(i, 0))
                if len(free) == 1:
                    fields[free[0]] += table
                elif free:
                    factors.append((tuple(new[v] for v in free), table))
            factors += [((new[v],), f) for v, f in fields.items()]
            part = Graph([graph.cards[v] for v in members], factors)
            result = Forest(part).infer()
            results[c] = result, own
            for (scope, _), m in zip(part.factors, result.marginals):
                for i, v in enumerate(scope):
                    q[members[v]] = m.sum(axis=tuple(j for j in range(len(scope)) if j != i))
            results[c] = Result(result.marginals, result.entropy(part)), own
        marginals: list[np.ndarray | None] = [None] * len(graph.factors)
        for result, own in results.values():
            for k, m in zip(own, result.marginals):
                marginals[k] = m
        for k in left_out:
            p = np.ones_like(graph.factors[k][1])
            for v in graph.factors[k][0]:
                p = p * graph.spread(k, q[v], v)
            marginals[k] = p
        now = sum(r.log_z for r, _ in results.values()) - sum(float((m * t).sum()) for m, (_, t) in zip(marginals, graph.factors))
        done, bound = now - bound < tol, now
        if done:
            break
    return Result(marginals, bound)


def _diffuse(graph: Graph, least, max_iter: int, tol: float) -> tuple[list[np.ndarray], list[np.ndarray | None], float]:
    """Averages what `least` (the minimum, or its soft form) leaves of each table for a variable with the variable's own
    table, till the sum of all tables' least values stands. (tables of variables, of factors with more of them, the sum)."""
    unary = [np.zeros(c) for c in graph.cards]
    tables: list[np.ndarray | None] = []
    for scope, table in graph.factors:
        if len(scope) == 1:
            unary[scope[0]] = unary[scope[0]] + table
        tables.append(table.copy() if len(scope) > 1 else None)
    bound = -np.inf
    for _ in range(max_iter):
        for (scope, _), table in zip(graph.factors, tables):
            for i, v in enumerate(scope) if table is not None else ():
                move = (unary[v] - least(table, tuple(j for j in range(len(scope)) if j != i))) / 2
                unary[v] = unary[v] - move
                table += move.reshape([-1 if j == i else 1 for j in range(len(scope))])
        now = sum(float(least(u, None)) for u in unary) + sum(float(least(t, None)) for t in tables if t is not None)
        done, bound = abs(now - bound) < tol, now
        if done:
            break
    return unary, tables, bound


def min_sum_diffusion(graph: Graph, max_iter: int = 100, tol: float = 1e-5) -> tuple[list[int], float, float]:
    """Averages min-marginals between factors and variables. Returns (state, energy, lower bound of all energies)."""
    unary, _, bound = _diffuse(graph, lambda t, axis: t.min(axis=axis), max_iter, tol)
    state = [int(np.argmin(u)) for u in unary]
    return state, graph.energy(state), bound


def sum_product_diffusion(graph: Graph, max_iter: int = 100, tol: float = 1e-5) -> Result:
    """As min_sum_diffusion() with -log sum exp(-energy) for the minimum: an upper bound of log Z, and the marginals of the
    tables it ends with."""
    unary, tables, bound = _diffuse(graph, lambda t, axis: -lse(-t, axis), max_iter, tol)
    final = [unary[scope[0]] if t is None else t for (scope, _), t in zip(graph.factors, tables)]
    return Result([np.exp(-t - float(lse(-t))) for t in final], -bound)


def tree_cover(graph: Graph) -> tuple[list[list[int]], list[int]]:
    """Forests of factors that together hold each factor; each takes least covered factors first. Unaries are in all."""
    unary = [k for k, (scope, _) in enumerate(graph.factors) if len(scope) == 1]
    wide = [k for k, (scope, _) in enumerate(graph.factors) if len(scope) > 1]
    count = {k: 0 for k in wide}
    trees: list[list[int]] = []
    while not trees or any(n == 0 for n in count.values()):
        label = list(range(len(graph.cards)))

        def root(v: int) -> int:
            while label[v] != v:
                v = label[v]
            return v

        tree = []
        for k in sorted(wide, key=lambda k: (count[k], k)):
            roots = [root(v) for v in graph.factors[k][0]]
            if len(set(roots)) == len(roots):
                for r in roots[1:]:
                    label[r] = roots[0]
                tree.append(k)
                count[k] += 1
        trees.append(sorted(tree + unary))
    return trees, [len(trees) if len(scope) == 1 else count[k] for k, (scope, _) in enumerate(graph.factors)]


def dual_decomposition_map(graph: Graph, max_iter: int = 100, tol: float = 1e-6) -> tuple[list[int], float, float]:
    """Exact minima of forests that share the energies, made to agree by subgradients. (state, energy, lower bound)."""
    missing = sorted(set(range(len(graph.cards))) - {scope[0] for scope, _ in graph.factors if len(scope) == 1})
    full = Graph(graph.cards, graph.factors + [((v,), np.zeros(graph.cards[v])) for v in missing])
    trees, count = tree_cover(full)
    first = {scope[0]: k for k, (scope, _) in reversed(list(enumerate(full.factors))) if len(scope) == 1}
    extra = [[np.zeros(c) for c in graph.cards] for _ in trees]
    best, bound = None, -np.inf
    for step in range(max_iter):
        dual, states = 0.0, []
        for t, tree in enumerate(trees):
            part = [(full.factors[k][0], full.factors[k][1] / count[k] + (extra[t][full.factors[k][0][0]] if first.get(full.factors[k][0][0]) == k else 0)) for k in tree]
            state, energy = Forest(Graph(graph.cards, part)).map()
            states.append(state)
            dual += energy
            primal = graph.energy(state)
            if best is None or primal < best[1]:
                best = state, primal
        bound = max(bound, dual)
        if best[1] - bound < tol:
            break
        marks = np.array(states)
        share = [np.bincount(marks[:, v], minlength=c) / len(trees) for v, c in enumerate(graph.cards)]
        norm = sum(float(((np.eye(c)[s[v]] - share[v]) ** 2).sum()) for s in states for v, c in enumerate(graph.cards))
        size = (best[1] - dual) / max(norm, 1e-12) / (1 + step / 20)
        for t, state in enumerate(states):
            for v, c in enumerate(graph.cards):
                extra[t][v] += size * (np.eye(c)[state[v]] - share[v])
    return best[0], best[1], bound


def proven_map(graph: Graph, state: list[int], bound=lambda g: min_sum_diffusion(g)[2]) -> tuple[list[int], float]:
    """The state of least energy; of equals the first with variable 0 running fastest. Starts from a state that a method
    found and looks through all others, but for those that `bound` (a lower bound of a graph's energies) shows to be worse."""
    best = list(state), graph.energy(state)
    line = [list(map(list, map(range, graph.cards)))]  # the states that are left to each variable
    while line:
        left = line.pop()
        free = [v for v, s in enumerate(left) if len(s) > 1]
        if not free:
            own = [s[0] for s in left]
            best = min(best, (own, graph.energy(own)), key=lambda x: (x[1], x[0][::-1]))
            continue
        part = Graph([len(s) for s in left], [(scope, table[np.ix_(*(left[v] for v in scope))]) for scope, table in graph.factors])
        if bound(part) > best[1] + 1e-9 * (1 + abs(best[1])):
            continue
        v = max(free, key=lambda u: len(left[u]))
        field = sum((t.min(axis=tuple(i for i, u in enumerate(scope) if u != v)) for scope, t in part.factors if v in scope), np.zeros(len(left[v])))
        line += [[[left[v][i]] if u == v else s for u, s in enumerate(left)] for i in np.argsort(-field, kind="stable")]
    return best
