"""Training over a DataFrame of labelled graphs: each evaluation is one job of partial sums, the optimizer runs on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import approximate, exact, sampling
from ..kernels.decompose import acyclic_greedy
from ..kernels.graph import Graph, lse
from . import optim, rbf


@dataclass
class Type:
    """A factor type to learn: its cardinalities, data_size (0: the table itself) and an optional prior and tie.

    rbf_n: each entry is a radial basis network of so many functions of the data; its weights are the amplitudes and
    centers of each entry in turn, as in the table of factor types, and a shared log_beta at the end.
    """

    name: str
    card: list[int]
    data_size: int = 0
    prior: object | None = None
    tie: list[int] | None = None
    rbf_n: int = 0

    @property
    def slots(self) -> int:
        return int(np.prod(self.card)) if self.tie is None else max(self.tie) + 1

    @property
    def size(self) -> int:
        if self.rbf_n:
            return self.slots * self.rbf_n * (1 + self.data_size) + 1
        return self.slots * max(self.data_size, 1)

    def networks(self, w: np.ndarray) -> list[rbf.Network]:
        n = self.rbf_n
        return [rbf.Network(r[:n], r[n:].reshape(n, -1), float(w[-1])) for r in w[:-1].reshape(self.slots, -1)]

    def energies(self, w: np.ndarray, data) -> np.ndarray:
        if self.rbf_n:
            return np.array([float(net.value(np.asarray(data, dtype=float)[None])[0]) for net in self.networks(w)])
        table = w.reshape(self.slots, -1) @ np.asarray(data, dtype=float) if self.data_size else w
        return table if self.tie is None else np.append(table, 0.0)[self.tie]

    def gradient(self, p: np.ndarray, data, w: np.ndarray | None = None) -> np.ndarray:
        """Of the energy expected under p (first variable fastest) with respect to the weights, at w where that matters."""
        if self.rbf_n:
            slopes = [net.slopes(np.asarray(data, dtype=float)[None], np.array([q])) for net, q in zip(self.networks(w), p)]
            return np.concatenate([*(x[:-1] for x in slopes), [sum(x[-1] for x in slopes)]])
        if self.tie is not None:
            p = np.bincount([t if t >= 0 else self.slots for t in self.tie], weights=p, minlength=self.slots + 1)[: self.slots]
        return np.outer(p, np.asarray(data, dtype=float)).ravel() if self.data_size else p


@dataclass
class Model:
    types: list[Type]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        if not len(self.weights):
            self.weights = np.zeros(sum(t.size for t in self.types))

    def save(self, path: str) -> None:
        """As one JSON file on this machine."""
        kinds = [{"name": t.name, "card": t.card, "data_size": t.data_size, "tie": t.tie, "rbf_n": t.rbf_n} for t in self.types]
        Path(path).write_text(json.dumps({"types": kinds, "weights": self.weights.tolist()}))

    @classmethod
    def load(cls, path: str) -> Model:
        """Priors are not saved."""
        found = json.loads(Path(path).read_text())
        return cls([Type(**t) for t in found["types"]], np.array(found["weights"], dtype=float))

    def parts(self) -> dict[str, tuple[Type, slice]]:
        out, at = {}, 0
        for t in self.types:
            out[t.name] = t, slice(at, at + t.size)
            at += t.size
        return out


def instances(factor: DataFrame, states: DataFrame) -> DataFrame:
    """A row per graph: graph_id, factors (type, vars, data) in order of factor_id, observed (var_id, state).

    Variables without a row in states are hidden. A graph must fit in one row.
    """
    f = factor.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("factor_id", "type", "vars", "data"))).alias("factors"))
    s = states.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("var_id", "state"))).alias("observed"))
    return f.join(s, "graph_id", "left")


def _marginals(graph: Graph) -> tuple[list[np.ndarray], float]:
    if graph.is_forest():
        r = exact.Forest(graph).infer()
    elif np.prod([float(c) for c in graph.cards]) <= 1 << 14:
        r = exact.enumerate_all(graph)
    else:
        r = approximate.belief_propagation(graph)
    return r.marginals, r.log_z


def _one_hot(graph: Graph, state) -> list[np.ndarray]:
    out = []
    for scope, table in graph.factors:
        p = np.zeros(table.shape)
        p[tuple(state[v] for v in scope)] = 1.0
        out.append(p)
    return out


def _clamped(graph: Graph, seen: dict[int, int]) -> tuple[list[np.ndarray], float]:
    """Marginals and log Z with the observed variables held."""
    big = 1e4
    held = Graph(graph.cards, graph.factors + [((v,), np.where(np.arange(graph.cards[v]) == s, 0.0, big)) for v, s in seen.items()])
    m, z = _marginals(held)
    return m[: len(graph.factors)], z


def likelihood(graph: Graph, state, seen, seed: int, before: Graph | None):
    """Negative log-likelihood; hidden variables enter by their distribution given the observed, under `before`."""
    free, z = _marginals(graph)
    if state is not None:
        target, energy = _one_hot(graph, state), graph.energy(state)
    else:
        target, _ = _clamped(before or graph, seen)
        energy = sum(float((t * e).sum()) for t, (_, e) in zip(target, graph.factors))
    return energy + z, [t - f for t, f in zip(target, free)]


def pseudolikelihood(graph: Graph, state, seen, seed: int, before: Graph | None):
    """-1/n sum of log p(variable | others)."""
    n, value, out = len(graph.cards), 0.0, [np.zeros(t.shape) for _, t in graph.factors]
    for v in range(n):
        score = -graph.site(v, state)
        z = float(lse(score))
        p = np.exp(score - z)
        value += (z - score[state[v]]) / n
        for k in graph.touching[v]:
            at = tuple(slice(None) if u == v else state[u] for u in graph.factors[k][0])
            own = -p
            own[state[v]] += 1
            out[k][at] += own / n
    return value, out


def _parts_of(graph: Graph, state, groups: list[list[int]]):
    """-log p of each group of variables given all others, and the slopes by factor."""
    value, slopes = 0.0, [np.zeros(t.shape) for _, t in graph.factors]
    for members in groups:
        new = {v: i for i, v in enumerate(members)}
        own = sorted({k for v in members for k in graph.touching[v]})
        cut = [tuple(slice(None) if v in new else state[v] for v in graph.factors[k][0]) for k in own]
        part = Graph([graph.cards[v] for v in members], [(tuple(new[v] for v in graph.factors[k][0] if v in new), graph.factors[k][1][at]) for k, at in zip(own, cut)])
        marginals, z = _marginals(part)
        mine = [state[v] for v in members]
        value += part.energy(mine) + z
        for k, at, one, m in zip(own, cut, _one_hot(part, mine), marginals):
            slopes[k][at] += one - m
    return value, slopes


def _grouped(label: list[int]) -> list[list[int]]:
    found: dict[int, list[int]] = {}
    for v, c in enumerate(label):
        found.setdefault(c, []).append(v)
    return list(found.values())


def composite(graph: Graph, state, seen, seed: int, before: Graph | None, cover: int = 0):
    """Composite likelihood: -log p of each part given the rest, the parts the trees that a cut leaves of the graph.

    cover 0: all factors weigh alike; -1: each variable is a part (pseudolikelihood, summed); k: the mean over k covers of
    random weights.
    """
    if cover < 0:
        return _parts_of(graph, state, [[v] for v in range(len(graph.cards))])
    rng = np.random.default_rng(seed)
    weights = [rng.random(len(graph.factors)).tolist() for _ in range(cover)] or [[1.0] * len(graph.factors)]
    found = [_parts_of(graph, state, _grouped(graph.components(acyclic_greedy(graph, w)))) for w in weights]
    return sum(v for v, _ in found) / len(found), [sum(g) / len(found) for g in zip(*(g for _, g in found))]


def criss_cross(graph: Graph, state, seen, seed: int, before: Graph | None):
    """For grids whose variables count row by row: -log p of each row and each column, a chain, given the rest."""
    pairs = {tuple(sorted(scope)) for scope, _ in graph.factors if len(scope) == 2}
    n = len(graph.cards)
    width = max((b - a for a, b in pairs), default=1)
    rows, columns = [list(range(r, r + width)) for r in range(0, n, width)], [list(range(c, n, width)) for c in range(width)]
    if n % width or pairs != {p for line in rows + columns for p in zip(line, line[1:])} or any(len(scope) > 2 for scope, _ in graph.factors):
        raise ValueError("the graph is no grid in the order of its rows")
    return _parts_of(graph, state, rows + columns)


def tree_pseudolikelihood(graph: Graph, state, seen, seed: int, before: Graph | None, given: list[list[int]] = ()):
    """-log p of a tree given each of the caller's sets of variables in turn (numbers in order of var_id)."""
    value, slopes = 0.0, [np.zeros(t.shape) for _, t in graph.factors]
    for held in given:
        rest = [v for v in range(len(graph.cards)) if v not in set(held)]
        v, g = _parts_of(graph, state, [rest])
        value, slopes = value + v, [a + b for a, b in zip(slopes, g)]
    return value, slopes


def piecewise(graph: Graph, state, seen, seed: int, before: Graph | None):
    """Each factor as a model of its own."""
    value, out = 0.0, []
    for (scope, table), one in zip(graph.factors, _one_hot(graph, state)):
        z = float(lse(-table))
        value += float((one * table).sum()) + z
        out.append(one - np.exp(-table - z))
    return value, out


def contrastive_divergence(graph: Graph, state, seen, seed: int, before: Graph | None, sweeps: int = 1):
    """Gradient at the observation less that some Gibbs sweeps on; the value is the energies' difference."""
    chain = sampling.Chain(graph, seed, fixed=seen if state is None else None)
    if state is None:
        chain.sweep(5)
        state = list(chain.state)
        chain.fixed = {}
    else:
        chain.state = list(state)
    start = list(state)
    chain.sweep(sweeps)
    return graph.energy(start) - graph.energy(chain.state), [a - b for a, b in zip(_one_hot(graph, start), _one_hot(graph, chain.state))]


def hinge(graph: Graph, state, seen, seed: int, before: Graph | None):
    """Margin-rescaled hinge with Hamming loss: the most violating labeling, exact on forests."""
    away = [((v,), (np.arange(c) == state[v]).astype(float) - 1.0) for v, c in enumerate(graph.cards)]
    harder = Graph(graph.cards, graph.factors + away)
    worst, energy = exact.Forest(harder).map() if harder.is_forest() else approximate.min_sum_diffusion(harder, max_iter=20)[:2]
    return graph.energy(state) - energy, [a - b for a, b in zip(_one_hot(graph, state), _one_hot(graph, worst))]


def violation(graph: Graph, state, seen, seed: int, before: Graph | None):
    """Perceptron: the observation against the least energy labeling; value 1 if they differ."""
    best, _ = exact.Forest(graph).map() if graph.is_forest() else approximate.min_sum_diffusion(graph, max_iter=20)[:2]
    return float(list(best) != list(state)), [a - b for a, b in zip(_one_hot(graph, state), _one_hot(graph, best))]


OBJECTIVES = {"mle": likelihood, "mple": pseudolikelihood, "mcle": composite, "mccle": criss_cross, "mtple": tree_pseudolikelihood, "npw": piecewise, "cd": contrastive_divergence, "ssvm": hinge, "perceptron": violation}


def evaluate(data: DataFrame, model: Model, objective: str, w: np.ndarray, before: np.ndarray | None = None, seed: int = 0, **options) -> tuple[float, np.ndarray, int]:
    """(mean value, mean gradient, number of graphs). Every task sums its graphs; the driver gets one row per task.

    options go to the objective: cover (mcle), given (mtple), sweeps (cd).
    """
    rule, parts = OBJECTIVES[objective], model.parts()
    shared = data.sparkSession.sparkContext.broadcast((w, before))

    def build(factors, cards_of: dict[int, int], new: dict[int, int], w: np.ndarray) -> Graph:
        return Graph.of([cards_of[v] for v in new], [([new[v] for v in f["vars"]], parts[f["type"]][0].energies(w[parts[f["type"]][1]], f["data"])) for f in factors])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, before = shared.value
        total, value, n = np.zeros(len(w)), 0.0, 0
        for batch in batches:
            for gid, factors, observed in zip(batch["graph_id"], batch["factors"], batch["observed"]):
                cards_of = {int(v): c for f in factors for v, c in zip(f["vars"], parts[f["type"]][0].card)}
                new = {v: i for i, v in enumerate(sorted(cards_of))}
                seen = {new[int(o["var_id"])]: int(o["state"]) for o in (observed if observed is not None else [])}
                state = [seen[i] for i in range(len(new))] if len(seen) == len(new) else None
                if state is None and objective not in ("mle", "cd"):
                    raise ValueError(f"{objective} needs fully observed graphs")
                graph = build(factors, cards_of, new, w)
                old = None if before is None else build(factors, cards_of, new, before)
                v, slopes = rule(graph, state, seen, (seed * 1_000_003 + int(gid)) % (1 << 31), old, **options)
                value, n = value + v, n + 1
                for f, g in zip(factors, slopes):
                    t, at = parts[f["type"]]
                    total[at] += t.gradient(g.ravel(order="F"), f["data"], w[at])
        yield pd.DataFrame({"value": [value], "n": [n], "g": [total]})

    rows = data.mapInPandas(run, "value double, n long, g array<double>").collect()  # one row per task
    n = sum(r.n for r in rows) or 1
    return sum(r.value for r in rows) / n, np.sum([r.g for r in rows], axis=0) / n, n


def prior_of(model: Model, w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    value, grad = 0.0, np.zeros_like(w)
    for t, at in model.parts().values():
        if t.prior is not None:
            v, g = t.prior.neg_log(w[at])
            value, grad[at] = value + v / n, g / n
    return value, grad


def mini_batch(data: DataFrame, batches: int, epoch: int, k: int, seed: int = 0) -> DataFrame:
    """The k-th of an epoch's batches of graphs: dealt anew in each epoch by a hash, every graph in one batch."""
    return data.where(F.pmod(F.xxhash64("graph_id", F.lit(seed), F.lit(epoch)), F.lit(batches)) == k)


def stochastic(data: DataFrame, model: Model, objective: str = "cd", epochs: int = 10, batches: int = 4, step: float = 1e-2, seed: int = 0, average: bool = False, **options) -> Model:
    """Constant steps along the gradients of mini-batches (a job each), with the prior's share of each batch.

    average: the mean of all weights on the way, as for the perceptron, which ends with an epoch without a mistake.
    """
    w, mean, count = model.weights.copy(), np.zeros(len(model.weights)), 0
    total = data.count() or 1
    for epoch in range(epochs):
        wrong = 0.0
        for k in range(batches):
            value, grad, n = evaluate(mini_batch(data, batches, epoch, k, seed), model, objective, w, seed=seed + epoch * batches + k, **options)
            wrong += value * n
            w = w - step * (grad + prior_of(model, w, total)[1])
            mean, count = mean + w, count + 1
        if objective == "perceptron" and wrong == 0:
            return Model(model.types, w)
    return Model(model.types, mean / count if average and count else w)


def sampled_perceptron(data: DataFrame, model: Model, steps: int = 200, per_step: int = 16, step: float = 1.0, average: bool = True, seed: int = 0) -> Model:
    """Perceptron on graphs drawn uniformly with replacement: each step draws per_step of them (by how often a hash of
    graph, step and draw falls below their share) and moves by the sum of their mistakes."""
    w, mean = model.weights.copy(), np.zeros(len(model.weights))
    total = data.count() or 1
    for k in range(steps):
        share = F.lit(per_step / total)
        drawn = data.where(F.pmod(F.xxhash64("graph_id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30) < share)
        _, grad, n = evaluate(drawn, model, "perceptron", w, seed=seed + k)
        w = w - step * grad * n / per_step
        mean += (w - mean) / (k + 1)
    return Model(model.types, mean if average else w)


def bundle(data: DataFrame, model: Model, c: float = 1.0, tol: float = 1e-3, max_iter: int = 100) -> tuple[Model, float, float]:
    """Structured SVM: |w|^2 / 2 + C times the mean hinge, by cutting planes; each plane is a job, the dual of all planes a
    small program over the simplex on the driver. Types must have a Normal prior or none; a prior's sigma scales its part
    of the norm. Returns (model, objective, lower bound).
    """
    scale = np.ones(len(model.weights))
    for t, at in model.parts().values():
        if t.prior is not None:
            scale[at] = t.prior.sigma**2
    w, slopes, offsets = np.zeros(len(scale)), [], []
    best, bound = (np.inf, w), -np.inf
    for _ in range(max_iter):
        value, grad, _ = evaluate(data, model, "ssvm", w)
        objective = float(w @ (w / scale)) / 2 + c * value
        best = min(best, (objective, w), key=lambda x: x[0])
        if best[0] - bound < tol * max(1.0, abs(best[0])):
            break
        slopes.append(grad)
        offsets.append(value - float(grad @ w))
        a, b = np.array(slopes), np.array(offsets)
        weight, bound = optim.simplex_quadratic(c * c * (a * scale) @ a.T, c * b)
        w = -c * scale * (weight @ a)
    return Model(model.types, best[1]), best[0], bound


def train(data: DataFrame, model: Model, objective: str = "mle", method: str = "lbfgs", tol: float = 1e-5, max_iter: int = 1000, seed: int = 0, **options) -> tuple[Model, float]:
    """Fits the weights: objective plus priors over the number of graphs. data (instances()) is read once per evaluation: cache it.

    options go to the objective. methods: lbfgs, gradient, bb, subgradient, fista, sgd (all graphs a step; stochastic() has
    mini-batches) and, for ssvm, bmrm (bundle() with C 1).
    """

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad, n = evaluate(data, model, objective, w, seed=seed, **options)
        more, slope = prior_of(model, w, n)
        return value + more, grad + slope

    if method == "bmrm":
        if objective != "ssvm":
            raise ValueError("bmrm minimizes the ssvm objective")
        return bundle(data, model, tol=tol, max_iter=max_iter)[:2]
    if method == "fista":

        def smooth(w: np.ndarray) -> tuple[float, np.ndarray]:
            return evaluate(data, model, objective, w, seed=seed, **options)[:2]

        n = data.count() or 1

        def prox(u: np.ndarray, strength: float) -> np.ndarray:
            out = u.copy()
            for t, at in model.parts().values():
                if t.prior is not None:
                    out[at] = t.prior.prox(u[at], strength * n)
            return out

        w, value = optim.fista(smooth, lambda w: prior_of(model, w, n)[0], prox, model.weights, tol, max_iter)
    elif method == "sgd":  # constant steps along noisy gradients, for contrastive divergence and the perceptron
        w, value = model.weights.copy(), 0.0
        mean = np.zeros_like(w)
        for k in range(max_iter):
            value, grad, n = evaluate(data, model, objective, w, seed=seed + k, **options)
            w = w - 0.5 * (grad + prior_of(model, w, n)[1])
            mean += (w - mean) / (k + 1)
            if objective == "perceptron" and value == 0:
                mean = w
                break
        w = mean
    elif method == "subgradient":
        w, value = optim.subgradient(f, model.weights, max_iter)
    else:
        rule: Callable = {"lbfgs": lambda: optim.lbfgs(f, model.weights, tol, max_iter, 200), "gradient": lambda: optim.gradient(f, model.weights, tol, max_iter), "bb": lambda: optim.barzilai_borwein(f, model.weights, tol, max_iter)}[method]
        w, value = rule()
    return Model(model.types, w), value


def expectation_maximization(data: DataFrame, model: Model, max_iter: int = 20, tol: float = 1e-4, inner: int = 20) -> tuple[Model, list[float]]:
    """Hidden variables by their distribution under the last weights (E), weights by maximum likelihood (M).

    Returns the model and the M-steps' objectives.
    """
    values: list[float] = []
    for _ in range(max_iter):
        before = model.weights

        def f(w: np.ndarray) -> tuple[float, np.ndarray]:
            value, grad, n = evaluate(data, model, "mle", w, before=before)
            more, slope = prior_of(model, w, n)
            return value + more, grad + slope

        w, value = optim.lbfgs(f, before, 1e-5, inner)
        model = Model(model.types, w)
        moved = np.abs(w - before).max()
        values.append(value)
        if moved < tol:
            break
    return model, values
