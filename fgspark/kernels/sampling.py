"""Monte Carlo inference; every sampler takes a seed, equal seeds give equal results."""

from __future__ import annotations

import numpy as np

from .graph import Graph, Result


class Chain:
    """Gibbs sampling of one state at an inverse temperature."""

    def __init__(self, graph: Graph, seed: int, beta: float = 1.0, fixed: dict[int, int] | None = None):
        self.graph, self.rng, self.beta, self.fixed = graph, np.random.default_rng(seed), beta, dict(fixed or {})
        self.state = [int(self.rng.integers(c)) for c in graph.cards]
        for v, s in self.fixed.items():
            self.state[v] = s

    def site(self, v: int) -> None:
        score = -self.beta * self.graph.site(v, self.state)
        p = np.exp(score - score.max())
        self.state[v] = min(int(np.searchsorted(np.cumsum(p / p.sum()), self.rng.random(), side="right")), len(p) - 1)

    def sweep(self, n: int = 1) -> None:
        for _ in range(n):
            for v in self.rng.permutation(len(self.state)).tolist():
                if v not in self.fixed:
                    self.site(v)


def tally(graph: Graph, states: np.ndarray, weights: np.ndarray | None = None) -> list[np.ndarray]:
    """Factor marginals of (weighted) samples, one row of states per sample."""
    out = []
    for scope, table in graph.factors:
        flat = np.ravel_multi_index([states[:, v] for v in scope], table.shape)
        counts = np.bincount(flat, weights=weights, minlength=table.size)
        out.append((counts / max(counts.sum(), 1e-300)).reshape(table.shape))
    return out


def gibbs_samples(graph: Graph, n: int, burn_in: int = 100, spacing: int = 0, seed: int = 0, fixed: dict[int, int] | None = None) -> np.ndarray:
    chain = Chain(graph, seed, fixed=fixed)
    for b in np.geomspace(0.1, 1.0, burn_in - burn_in // 2) if burn_in else ():
        chain.beta = float(b)
        chain.sweep()
    chain.beta = 1.0
    chain.sweep(burn_in // 2)
    out = np.empty((n, len(graph.cards)), dtype=int)
    for i in range(n):
        chain.sweep(1 + spacing)
        out[i] = chain.state
    return out


def gibbs(graph: Graph, samples: int = 1000, burn_in: int = 100, spacing: int = 0, seed: int = 0) -> Result:
    return Result(tally(graph, gibbs_samples(graph, samples, burn_in, spacing, seed)), None)


def psrf(means: np.ndarray, variances: np.ndarray, n: int) -> np.ndarray:
    """Potential scale reduction of chains (rows) of n samples; 0 where they don't vary."""
    within = variances.mean(axis=0)
    between = means.var(axis=0, ddof=1)
    pooled = (n - 1) / n * within + between * (1 + 1 / len(means))
    return np.where(within < 1e-12, 0.0, np.sqrt(pooled / np.maximum(within, 1e-12)))


def multichain_gibbs(graph: Graph, chains: int = 5, accept: float = 1.01, spacing: int = 0, samples: int = 1000, seed: int = 0, most_sweeps: int = 20_000) -> Result:
    """Chains run until all marginal entries have a PSRF of at most accept, then share the samples."""
    if chains < 3:
        raise ValueError("3 chains or more are needed")
    runs = [Chain(graph, seed * 1009 + c) for c in range(chains)]
    indicator = lambda state: np.concatenate([np.eye(t.size)[np.ravel_multi_index([state[v] for v in scope], t.shape)] for scope, t in graph.factors])
    total = [indicator(r.state) * 0 for r in runs]
    for n in range(1, most_sweeps + 1):
        for c, run in enumerate(runs):
            run.sweep()
            total[c] += indicator(run.state)
        if n % 10 == 0:
            mean = np.array(total) / n
            if psrf(mean, mean * (1 - mean) * n / (n - 1), n).max() <= accept:
                break
    rows = []
    for c, run in enumerate(runs):
        for _ in range(-(-samples // chains)):
            run.sweep(1 + spacing)
            rows.append(list(run.state))
    return Result(tally(graph, np.array(rows[:samples])), None)


def annealed_importance(graph: Graph, samples: int = 100, temperatures: int = 80, sweeps: int = 1, seed: int = 0) -> Result:
    """Weighted samples from the uniform distribution to the graph's; their mean weight estimates Z."""
    betas = np.linspace(0.0, 1.0, temperatures + 1)
    base = float(sum(np.log(c) for c in graph.cards))
    states, weights = [], []
    for s in range(samples):
        chain, w = Chain(graph, seed * 1_000_003 + s, beta=0.0), 0.0
        for a, b in zip(betas, betas[1:]):
            w -= (b - a) * graph.energy(chain.state)
            chain.beta = float(b)
            chain.sweep(sweeps)
        states.append(list(chain.state))
        weights.append(w)
    w = np.array(weights)
    share = np.exp(w - w.max())
    return Result(tally(graph, np.array(states), share), base + float(w.max() + np.log(share.mean())))


def parallel_tempering(graph: Graph, levels: int = 20, high: float = 20.0, swap: float = 0.5, burn_in: int = 1000, samples: int = 1000, seed: int = 0) -> tuple[Result, np.ndarray]:
    """Chains on a ladder of temperatures that swap states. Returns (Result, share of accepted swaps by level)."""
    betas = 1 / np.geomspace(1.0, high, levels)
    chains = [Chain(graph, seed * 7919 + i, beta=float(b)) for i, b in enumerate(betas)]
    rng = np.random.default_rng(seed)
    tried, done, rows = np.zeros(max(levels - 1, 1)), np.zeros(max(levels - 1, 1)), []
    for t in range(burn_in + samples):
        if levels > 1 and rng.random() < swap:
            i = int(rng.integers(levels - 1))
            a, b = chains[i], chains[i + 1]
            tried[i] += 1
            if np.log(rng.random()) < (betas[i] - betas[i + 1]) * (graph.energy(a.state) - graph.energy(b.state)):
                a.state, b.state = b.state, a.state
                done[i] += 1
        else:
            for chain in chains:
                chain.sweep()
        if t >= burn_in:
            rows.append(list(chains[0].state))
    return Result(tally(graph, np.array(rows)), None), done / np.maximum(tried, 1)


def stochastic_approximation(graph: Graph, levels: int = 20, high: float = 20.0, jump: float = 0.5, burn_in: int = 1000, samples: int = 1000, seed: int = 0) -> tuple[Result, np.ndarray, np.ndarray]:
    """One chain over states and temperatures, whose level weights are learnt on the way so that all are visited alike.

    Returns (Result, visits by level, log Z of the levels relative to the first).
    """
    temperatures = np.geomspace(1.0, high, levels)
    chain, rng, theta, level = Chain(graph, seed), np.random.default_rng(seed + 1), np.zeros(levels), levels - 1
    visits, rows, t = np.zeros(levels), [], 0
    while len(rows) < samples and t < 1000 * (burn_in + samples):
        t += 1
        chain.beta = 1 / temperatures[level]
        if rng.random() < jump:
            to = level + (1 if rng.random() < 0.5 else -1)
            if 0 <= to < levels:
                accept = graph.energy(chain.state) * (1 / temperatures[level] - 1 / temperatures[to]) + theta[level] - theta[to]
                if np.log(rng.random()) < accept:
                    level = to
        else:
            chain.sweep()
        gain = burn_in / max(burn_in, t)
        theta -= gain / levels
        theta[level] += gain
        if t > burn_in:
            visits[level] += 1
            if level == 0:
                rows.append(list(chain.state))
    return Result(tally(graph, np.array(rows or [chain.state])), None), visits, theta - theta[0]


def simulated_annealing(graph: Graph, steps: int = 100, start: float = 10.0, end: float = 0.05, seed: int = 0) -> tuple[list[int], float]:
    """Gibbs sweeps under falling temperature; the best state seen."""
    chain, best = Chain(graph, seed), None
    for t in np.geomspace(start, end, steps):
        chain.beta = 1 / float(t)
        for v in range(len(graph.cards)):
            chain.site(v)
        energy = graph.energy(chain.state)
        if best is None or energy < best[1]:
            best = list(chain.state), energy
    return best


def edge_probabilities(graph: Graph, temperature: float = 1.0) -> dict[int, float]:
    """For each pair factor with equal cardinalities: logistic of how much less agreeing states cost on average."""
    out = {}
    for k, (scope, table) in enumerate(graph.factors):
        if len(scope) == 2 and table.shape[0] == table.shape[1]:
            same = np.eye(len(table), dtype=bool)
            gap = float(table[~same].mean() - table[same].mean()) / temperature
            out[k] = 1 / (1 + np.exp(-gap))
    return out


def network_reliability(n: int, edges: list[tuple[int, int]], q: list[float], runs: int = 1000, seed: int = 0) -> np.ndarray:
    """For each edge, how often its ends are connected when edges stay with probability q."""
    rng, hits = np.random.default_rng(seed), np.zeros(len(edges))
    for _ in range(runs):
        on = rng.random(len(edges)) < np.asarray(q)
        g = Graph([2] * n, [((a, b), np.zeros((2, 2))) for (a, b), k in zip(edges, on) if k])
        label = g.components()
        hits += [label[a] == label[b] for a, b in edges]
    return hits / runs


def swendsen_wang(graph: Graph, q: dict[int, float] | None = None, samples: int = 100, burn_in: int = 50, spacing: int = 0, seed: int = 0) -> Result:
    """Clusters of agreeing neighbours, grown along pair factors with probability q, change state together.

    Needs unary and pair factors and one cardinality. The cut edges' ln(1 - q) corrects for how a cluster came about.
    """
    if any(len(scope) > 2 for scope, _ in graph.factors) or len(set(graph.cards)) != 1:
        raise ValueError("unary and pair factors and equal cardinalities are needed")
    q = {k: min(max(p, 1e-6), 1 - 1e-3) for k, p in (q or edge_probabilities(graph)).items()}
    chain, rows = Chain(graph, seed), []
    rng, state, card = chain.rng, chain.state, graph.cards[0]

    def step() -> int:
        start = int(rng.integers(len(state)))
        cluster, line, label = {start}, [start], state[start]
        for v in line:
            for k in graph.touching[v]:
                scope = graph.factors[k][0]
                if len(scope) == 2:
                    u = scope[0] if scope[1] == v else scope[1]
                    if u not in cluster and state[u] == label and rng.random() < q.get(k, 0.0):
                        cluster.add(u)
                        line.append(u)
        touched = {k for v in cluster for k in graph.touching[v]}
        score = np.zeros(card)
        for s in range(card):
            for v in cluster:
                state[v] = s
            for k in touched:
                scope, table = graph.factors[k]
                score[s] -= table[tuple(state[v] for v in scope)]
                if len(scope) == 2 and (scope[0] in cluster) != (scope[1] in cluster) and state[scope[0]] == state[scope[1]]:
                    score[s] += np.log1p(-q.get(k, 0.0))
        p = np.exp(score - score.max())
        new = min(int(np.searchsorted(np.cumsum(p / p.sum()), rng.random(), side="right")), card - 1)
        for v in cluster:
            state[v] = new
        return len(cluster)

    for i in range(burn_in + samples * (1 + spacing)):
        moved = 0
        while moved < len(state):
            moved += step()
        if i >= burn_in and (i - burn_in) % (1 + spacing) == 0:
            rows.append(list(state))
    return Result(tally(graph, np.array(rows)), None)
