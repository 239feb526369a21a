"""Golden values of small graphs, and methods against enumeration."""

import numpy as np
import pytest

from fgspark.kernels import approximate, decompose, exact, sampling
from fgspark.kernels.graph import Graph

PAIR = [((0, 1), [0, 0.3, 0.2, 0]), ((0,), [0.1, 0.7]), ((1,), [0.3, 0.6])]


def pair():
    return Graph.of([2, 2], PAIR)


def flat(result):
    return [m.ravel(order="F") for m in result.marginals]


@pytest.mark.parametrize("infer", [exact.enumerate_all, lambda g: exact.Forest(g).infer(), approximate.belief_propagation])
def test_pair(infer):
    result = infer(pair())
    assert result.log_z == pytest.approx(0.4836311, abs=1e-6)
    joint, a, b = flat(result)
    assert joint == pytest.approx([0.4132795, 0.1680269, 0.2506666, 0.1680269], abs=1e-6)
    assert a == pytest.approx([0.6639461, 0.3360538], abs=1e-6)
    assert b == pytest.approx([0.5813064, 0.4186935], abs=1e-6)


def test_energies_and_least_state():
    g = pair()
    assert [g.energy(s) for s in ((0, 0), (0, 1), (1, 0), (1, 1))] == pytest.approx([0.4, 0.9, 1.3, 1.3])
    for state, energy in (exact.enumerate_map(g), exact.Forest(g).map(), approximate.min_sum_diffusion(g)[:2], approximate.dual_decomposition_map(g)[:2], sampling.simulated_annealing(g)):
        assert list(state) == [0, 0] and energy == pytest.approx(0.4)


def test_all_ones_and_entropy():
    g = Graph.of([2, 2], [((0, 1), [1] * 4), ((0,), [1, 1]), ((1,), [1, 1])])
    result = exact.Forest(g).infer()
    assert result.log_z == pytest.approx(np.log(4 * np.exp(-3)))
    assert result.entropy(g) == pytest.approx(np.log(4))


def test_disconnected():
    result = exact.Forest(Graph.of([2, 2], PAIR[1:])).infer()
    assert result.log_z == pytest.approx(0.591843, abs=1e-5)
    assert flat(result)[0] == pytest.approx([0.64566, 0.354346], abs=1e-4)


def test_mean_field_and_importance():
    g = Graph.of([2, 2], [((0, 1), [0.8, 0.5, 2, 0.6])])
    result = approximate.mean_field(g)
    assert result.log_z == pytest.approx(0.52342, abs=1e-3)
    assert flat(result)[0] == pytest.approx([0.1996, 0.4131, 0.1262, 0.2611], abs=0.01)
    assert sampling.annealed_importance(g, 600, seed=1).log_z == pytest.approx(0.5539, abs=0.03)
    triple = Graph.of([2, 2, 2], [((0, 1, 2), [0.8, 0.5, 2, 0.6, 0.1, 0.7, 0.5, 0.9])])
    assert exact.enumerate_all(triple).log_z == pytest.approx(1.4242, abs=1e-4)
    assert approximate.mean_field(triple).log_z == pytest.approx(1.3634, abs=1e-3)


def test_least_state_of_triple():
    g = Graph.of([2, 2, 2], [((0, 1), [0, 0.3, 0.2, 0.05]), ((0, 1, 2), [0.1, 0.7, 0.3, -0.3, 0.2, 0.5, 0, -0.5])])
    assert exact.enumerate_map(g) == ([1, 1, 1], pytest.approx(-0.45))
    assert approximate.min_sum_diffusion(g)[0] == [1, 1, 1]


def random_tree(rng, n):
    return Graph.of([3] * n, [((v,), rng.normal(size=3)) for v in range(n)] + [((int(rng.integers(v)), v), rng.normal(size=9)) for v in range(1, n)])


def grid(rng, n):
    f = [((i * n + j,), rng.normal(size=2)) for i in range(n) for j in range(n)]
    f += [((i * n + j, i * n + j + 1), rng.normal(size=4) / 2) for i in range(n) for j in range(n - 1)]
    f += [((i * n + j, i * n + n + j), rng.normal(size=4) / 2) for i in range(n - 1) for j in range(n)]
    return Graph.of([2] * n * n, f)


def test_forests_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        g = random_tree(rng, n)
        a, b, c = exact.enumerate_all(g), exact.Forest(g).infer(), approximate.belief_propagation(g, tol=1e-12)
        assert a.log_z == pytest.approx(b.log_z) == pytest.approx(c.log_z, abs=1e-6)
        for x, y in zip(a.marginals, b.marginals):
            assert np.allclose(x, y)
        assert exact.Forest(g).map()[1] == pytest.approx(exact.enumerate_map(g)[1])


def test_bounds_on_a_grid():
    g = grid(np.random.default_rng(2), 3)
    best, z = exact.enumerate_map(g)[1], exact.enumerate_all(g).log_z
    assert approximate.mean_field(g).log_z < z
    rows = {k for k, (s, _) in enumerate(g.factors) if len(s) == 2 and s[1] - s[0] == 1}
    assert approximate.mean_field(g).log_z - 1e-6 < approximate.structured_mean_field(g, rows).log_z < z + 1e-9
    for _, energy, bound in (approximate.min_sum_diffusion(g), approximate.dual_decomposition_map(g)):
        assert bound <= best + 1e-6 <= energy + 2e-6
    with pytest.raises(ValueError):
        exact.Forest(g)


@pytest.mark.parametrize(
    "sampler",
    [lambda g: sampling.gibbs(g, 3000, seed=1), lambda g: sampling.multichain_gibbs(g, samples=2500, accept=1.02, seed=1), lambda g: sampling.swendsen_wang(g, samples=2500, seed=1), lambda g: sampling.parallel_tempering(g, levels=4, burn_in=100, samples=4000, seed=1)[0], lambda g: sampling.stochastic_approximation(g, levels=4, high=4, burn_in=300, samples=3000, seed=1)[0]],
)
def test_samplers(sampler):
    g = grid(np.random.default_rng(4), 2)
    want, got = exact.enumerate_all(g).marginals, sampler(g).marginals
    assert max(np.abs(a - b).max() for a, b in zip(want, got)) < 0.09


def test_exact_samples_and_seeds():
    g = pair()
    a, b = (exact.Forest(g).sample(4000, np.random.default_rng(3)) for _ in range(2))
    assert (a == b).all()
    assert sampling.tally(g, a)[0].ravel(order="F") == pytest.approx([0.4132795, 0.1680269, 0.2506666, 0.1680269], abs=0.03)


def test_reliability_and_cover():
    assert sampling.network_reliability(4, [(0, 1), (0, 2), (1, 2), (2, 3)], [0.5] * 4, 6000, 1) == pytest.approx([0.625, 0.625, 0.625, 0.5], abs=0.03)
    g = grid(np.random.default_rng(0), 4)
    trees, count = approximate.tree_cover(g)
    assert len(trees) == 2 and min(count) >= 1
    for tree in trees:
        assert Graph(g.cards, [g.factors[k] for k in tree]).is_forest()


def ring(weights):
    n = len(weights)
    return Graph.of([2] * n, [((i, (i + 1) % n), [0] * 4) for i in range(n)])


def test_induced_forests():
    weights = [1, 0.5, 1, 0.3]
    for rule in (decompose.acyclic_exact, decompose.acyclic_greedy, decompose.acyclic_annealed, decompose.acyclic_packed):
        assert rule(ring(weights), weights) == {1, 3}
    g = Graph.of([2] * 9, [s for s in ((f[0], f[1].ravel(order="F")) for f in grid(np.random.default_rng(0), 3).factors) if len(s[0]) == 2])
    exact_, greedy = (len(g.factors) - len(rule(g, [1.0] * len(g.factors))) for rule in (decompose.acyclic_exact, decompose.acyclic_greedy))
    assert exact_ >= greedy and exact_ == 7  # two induced trees


def test_set_packing_and_trails():
    sets = [{0, 1}, {1, 2}, {2, 3}, {3, 4}, {0, 4}, {2, 5}, {3, 5}, {4, 5}]
    chosen, value, bound = decompose.set_packing(sets, [3, 2, 7, 9, 8, 1, 4, 4])
    assert value <= bound + 1e-9
    assert value == 15 and sum(chosen) == 2
    steps = decompose.message_schedule(ring([1] * 5))
    assert len(steps) == len(set(steps)) == 20 and all(a[1] == b[0] for a, b in zip(steps, steps[1:]))


def test_random_trees():
    for seed in range(5):
        g = decompose.random_tree([[2, 2], [2, 3, 2], [3]], [1, 1, 0.5], 12, seed)
        assert g.is_forest() and len(g.factors) == 12 and len(set(g.components())) == 1


def test_sum_product_diffusion():
    found = approximate.sum_product_diffusion(pair(), 10, 1e-6)
    assert found.log_z == pytest.approx(1.8367, abs=1e-2)
    joint, a, b = flat(found)
    assert joint == pytest.approx([0.3422, 0.1939, 0.2399, 0.2240], abs=0.01)
    assert a == pytest.approx([0.5821, 0.4179], abs=0.01) and b == pytest.approx([0.5361, 0.4639], abs=0.01)
    rng = np.random.default_rng(3)
    for _ in range(20):
        g = Graph.of([2, 3, 2], [((0, 1), rng.normal(size=6)), ((1, 2), rng.normal(size=6)), ((0, 2), rng.normal(size=4)), ((1,), rng.normal(size=3))])
        assert approximate.sum_product_diffusion(g, 300).log_z >= exact.enumerate_all(g).log_z - 1e-9


def test_set_packing_against_all_choices():
    rng = np.random.default_rng(9)
    near = 0
    for _ in range(60):
        sets = [set(rng.choice(7, size=rng.integers(1, 4), replace=False).tolist()) for _ in range(8)]
        weights = rng.random(8).tolist()
        best = max(sum(w for j, w in enumerate(weights) if m >> j & 1) for m in range(256) if sum(len(s) for j, s in enumerate(sets) if m >> j & 1) == len(set().union(*(s for j, s in enumerate(sets) if m >> j & 1))))
        chosen, value, bound = decompose.set_packing(sets, weights)
        used = [e for s, c in zip(sets, chosen) if c for e in s]
        assert len(used) == len(set(used)) and value == pytest.approx(sum(w for w, c in zip(weights, chosen) if c))
        assert value <= best + 1e-9 <= bound + 2e-9
        near += value >= best - 1e-9
    assert near >= 50
    assert decompose.set_packing([], []) == ([], 0, 0)


def test_unions_are_undone():
    rng, sets, past = np.random.default_rng(4), decompose.UndoSets(9), []
    for _ in range(300):
        if past and rng.random() < 0.45:
            sets.undo()
            past.pop()
        else:
            past.append(tuple(int(v) for v in rng.integers(9, size=2)))
            sets.union(*past[-1])
        g = Graph([2] * 9, [(p, np.zeros((2, 2))) for p in past if p[0] != p[1]])
        label = g.components()
        assert sets.count == len(set(label)) and all((sets.find(a) == sets.find(b)) == (label[a] == label[b]) for a in range(9) for b in range(9))


def test_exact_cover_within_epsilon():
    rng = np.random.default_rng(5)
    pairs = [(r * 3 + c, r * 3 + c + 1) for r in range(3) for c in range(2)] + [(r * 3 + c, r * 3 + c + 3) for r in range(2) for c in range(3)]
    g = Graph.of([2] * 9, [(p, [0] * 4) for p in pairs])
    weights = rng.random(len(pairs)).tolist()
    kept = lambda out: sum(w for k, w in enumerate(weights) if k not in out)
    best = kept(decompose.acyclic_exact(g, weights))
    assert best - 0.5 <= kept(decompose.acyclic_exact(g, weights, 0.5)) <= best + 1e-9
    assert kept(decompose.acyclic_packed(g, weights)) <= best + 1e-9
