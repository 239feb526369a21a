"""Elimination by joins against the kernels."""

import numpy as np
import pytest

from fgspark.kernels import exact
from fgspark.kernels.graph import Graph
from fgspark.operators import elimination


def tables(spark, graphs):
    variable = spark.createDataFrame([(g, v, c) for g, x in enumerate(graphs) for v, c in enumerate(x.cards)], "graph_id bigint, var_id int, card int")
    factor = spark.createDataFrame([(g, k, list(vs), [float(e) for e in t.ravel(order="F")]) for g, x in enumerate(graphs) for k, (vs, t) in enumerate(x.factors)], "graph_id bigint, factor_id int, vars array<int>, energies array<double>")
    return variable, factor


def graphs(rng):
    chain = Graph.of([2, 3, 2, 2, 3, 2, 2], [((i, i + 1) if i % 2 else (i + 1, i), rng.normal(size=[6, 6, 4, 6, 6, 4][i])) for i in range(6)] + [((1,), rng.normal(size=3)), ((1,), rng.normal(size=3))])
    tree = Graph.of([2] * 9, [((max(0, (i - 1) // 3), i), rng.normal(size=4)) for i in range(1, 8)] + [((i,), rng.normal(size=2)) for i in range(9)])
    return [chain, tree]


@pytest.mark.parametrize("finish", [0, 6])
def test_forests_and_a_loop(spark, finish):
    rng = np.random.default_rng(12)
    made = graphs(rng)
    if not finish:
        made.append(Graph.of([2, 2, 3, 2], [((0, 1), rng.normal(size=4)), ((1, 2), rng.normal(size=6)), ((2, 3), rng.normal(size=6)), ((0, 3), rng.normal(size=4)), ((1, 0), rng.normal(size=4)), ((2,), rng.normal(size=3))]))
    variable, factor = tables(spark, made)
    log_z, one, two = elimination.infer(factor, variable, finish=finish)
    want = [exact.enumerate_all(g) for g in made]
    assert {r.graph_id: r.log_z for r in log_z.collect()} == pytest.approx({g: w.log_z for g, w in enumerate(want)})
    p = {(r.graph_id, r.var_id, r.s): r.p for r in one.collect()}
    q = {(r.graph_id, r.a, r.b, r.ei): r.p for r in two.collect()}
    assert len(p) == sum(sum(g.cards) for g in made)
    for g, (x, w) in enumerate(zip(made, want)):
        for (scope, _), m in zip(x.factors, w.marginals):
            if len(scope) == 1:
                assert [p[g, scope[0], s] for s in range(len(m))] == pytest.approx(m.tolist())
            else:
                flat = (m if scope[0] < scope[1] else m.T).ravel(order="F")
                assert [q[g, min(scope), max(scope), i] for i in range(len(flat))] == pytest.approx(flat.tolist())
                assert [sum(q[g, min(scope), max(scope), i] for i in range(len(flat)) if i % x.cards[min(scope)] == s) for s in range(x.cards[min(scope)])] == pytest.approx([p[g, min(scope), s] for s in range(x.cards[min(scope)])])


def test_graphs_that_do_not_come_apart(spark):
    rng = np.random.default_rng(1)
    variable, factor = tables(spark, [Graph.of([2] * 4, [((a, b), rng.normal(size=4)) for a in range(4) for b in range(a)])])
    with pytest.raises(ValueError, match="three neighbours"):
        elimination.infer(factor, variable, finish=0)
    variable, factor = tables(spark, [Graph.of([2] * 3, [((0, 1, 2), rng.normal(size=8))])])
    with pytest.raises(ValueError, match="one and two"):
        elimination.infer(factor, variable)


@pytest.mark.parametrize("finish", [0, 10_000])
def test_depths_by_rounds(spark, finish):
    """A long chain, a tree with wide factors, a loop, and a variable on its own."""
    from fgspark.operators import energies, structure

    rows = [(0, k, [k, k + 1]) for k in range(60)] + [(1, k, [max(0, (k - 1) // 2) * 2, 2 * k + 1, 2 * k + 2]) for k in range(8)] + [(2, k, [k, (k + 1) % 7]) for k in range(7)]
    factor = spark.createDataFrame(rows, "graph_id bigint, factor_id int, vars array<int>")
    ids = {(g, v) for g, _, vs in rows for v in vs} | {(3, 5)}
    variable = spark.createDataFrame([(g, v, 2) for g, v in sorted(ids)], "graph_id bigint, var_id int, card int")
    got = {(r.graph_id, r.var_id): r.depth for r in structure.depths(energies.scopes(factor, variable), variable, finish).collect()}
    want, line = {}, [(g, min(v for h, v in ids if h == g), 0) for g in range(4)]
    for g, v, d in line:  # breadth first
        if (g, v) not in want:
            want[g, v] = d
            line += [(g, w, d + 1) for h, _, vs in rows if h == g and v in vs for w in vs]
    assert got == {k: d for k, d in want.items()}


@pytest.mark.parametrize("bits", [0, 1, 2, 10])
def test_blocks_without_marginals(spark, monkeypatch, bits):
    """log Z alone: trees, loops, repeated and turned factors, an impossible state, a lone variable, for blocks of all sizes."""
    monkeypatch.setattr(elimination, "BLOCK_BITS", bits)
    rng = np.random.default_rng(14)
    made = graphs(rng)
    made.append(Graph.of([2, 2, 3, 2, 2], [((0, 1), rng.normal(size=4)), ((1, 2), rng.normal(size=6)), ((2, 3), rng.normal(size=6)), ((0, 3), rng.normal(size=4)), ((1, 0), rng.normal(size=4)), ((2,), rng.normal(size=3))]))
    made.append(Graph.of([3, 2, 2], [((2, 0), [0.1, np.inf, 0.4, 0.2, np.inf, 0.3]), ((1,), [np.inf, 0.2]), ((0, 1), rng.normal(size=6))]))
    variable, factor = tables(spark, made)
    if not bits:  # the kernel's part is then small, the rounds of joins do the rest
        assert elimination._blocks_out(factor, variable)[0].count() > 10
    got = {r.graph_id: r.log_z for r in elimination.infer(factor, variable, finish=0, marginals=False)[0].collect()}
    assert got == pytest.approx({g: exact.enumerate_all(x).log_z for g, x in enumerate(made)})


def test_blocks_of_events_need_no_rounds(spark):
    """Chains of the events' length go in the first round; it took ten rounds of joins and more before."""
    variable, factor = tables(spark, [Graph.of([5] * 60, [((i, i + 1), np.arange(25) / 7) for i in range(59)]) for _ in range(3)])
    nodes, edges, constant = elimination._blocks_out(factor, variable)
    assert nodes.count() == edges.count() == 0 and constant.count() == 3
