"""Priors, optimizers and training."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fgspark.kernels import exact
from fgspark.kernels.graph import Graph
from fgspark.learn import optim
from fgspark.learn.priors import Hyperbolic, Laplace, Normal, StudentT
from fgspark.learn.training import Model, Type, bundle, evaluate, expectation_maximization, instances, mini_batch, sampled_perceptron, stochastic, train


@pytest.mark.parametrize("prior", [Normal(0.5), Laplace(0.7), StudentT(3, 0.8), Hyperbolic(1.2, 0.7)])
def test_priors_are_densities_with_their_gradient(prior):
    w = np.array([0.3, -0.4])
    assert optim.gradient_error(prior.neg_log, w, 1) < 1e-6
    x = np.linspace(-60, 60, 240_001)
    mass = np.trapezoid(np.exp([-prior.neg_log(np.array([v]))[0] for v in x[::20]]), x[::20])
    assert mass == pytest.approx(1, abs=0.03)


def test_smooth_minima():
    a, b = np.array([[0.8, 0.4], [0.4, 0.5]]), np.array([-0.3, 0.6])
    f = lambda x: (float(x @ a @ x - b @ x), 2 * a @ x - b)
    for rule in (optim.lbfgs, optim.barzilai_borwein, optim.gradient):
        x, value = rule(f, np.zeros(2), 1e-8, 5000)
        assert value == pytest.approx(-0.49687, abs=1e-4) and x == pytest.approx([-0.8125, 1.25], abs=1e-3)
    rosen = lambda x: (float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    assert optim.lbfgs(rosen, np.array([0.03, 0.1]), 1e-8)[0] == pytest.approx([1, 1], abs=1e-4)


def test_composite_minimum_and_simplex():
    q = np.array([[1.5, 0.4], [0.4, 0.5]])
    f = lambda x: (float(0.6 * x[0] - 0.2 * x[1] + 0.5 * x @ q @ x), np.array([0.6, -0.2]) + q @ x)
    x, value = optim.fista(f, lambda x: 0.35 * float(np.abs(x).sum()), lambda u, s: np.sign(u) * np.maximum(np.abs(u) - 0.35 / s, 0), np.zeros(2), 1e-9)
    assert value == pytest.approx(-0.0208333, abs=1e-5) and x == pytest.approx([-0.1666666, 0], abs=1e-4)
    assert optim.simplex_projection(np.array([0.5, 2.0, -1.0])) == pytest.approx([0, 1, 0])


@pytest.fixture(scope="module")
def chains(spark):
    """400 samples of a 3-variable chain with shared pair weights."""
    w = np.array([1, 0.2, -0.2, 1.0])
    g = Graph.of([2] * 3, [((0, 1), w), ((1, 2), w)])
    x = exact.Forest(g).sample(1500, np.random.default_rng(7))
    factor = spark.createDataFrame([(i, k, "pair", [k, k + 1], []) for i in range(len(x)) for k in (0, 1)], "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>")
    states = spark.createDataFrame([(i, v, int(s)) for i, row in enumerate(x) for v, s in enumerate(row)], "graph_id bigint, var_id int, state int")
    return factor, states, instances(factor, states).coalesce(4).cache(), exact.enumerate_all(g).marginals


@pytest.mark.parametrize("objective", ["mle", "mple"])
def test_training_recovers_marginals(chains, objective):
    model, _ = train(chains[2], Model([Type("pair", [2, 2], prior=Normal(10))]), objective, max_iter=25, tol=1e-4)
    got = exact.enumerate_all(Graph.of([2] * 3, [((0, 1), model.weights), ((1, 2), model.weights)])).marginals
    assert max(np.abs(a - b).max() for a, b in zip(got, chains[3])) < 0.06


@pytest.mark.parametrize("objective", ["mle", "mple", "mcle", "npw"])
def test_gradients(chains, objective):
    model = Model([Type("pair", [2, 2])])
    f = lambda w: evaluate(chains[2], model, objective, w)[:2]
    assert optim.gradient_error(f, np.array([0.3, -0.2, 0.1, 0.4]), 2) < 1e-6


def test_softmax_of_one_variable_is_the_frequency(spark):
    factor = spark.createDataFrame([(i, 0, "u", [0], []) for i in range(10)], "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>")
    states = spark.range(10).select(F.col("id").alias("graph_id"), F.lit(0).alias("var_id"), (F.col("id") < 3).cast("int").alias("state"))
    model, value = train(instances(factor, states), Model([Type("u", [2])]), "mle", max_iter=15)
    p = np.exp(-model.weights) / np.exp(-model.weights).sum()
    assert p == pytest.approx([0.7, 0.3], abs=1e-3)
    assert value == pytest.approx(-(0.7 * math.log(0.7) + 0.3 * math.log(0.3)), abs=1e-4)


def test_margin_and_perceptron_separate(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    factor = spark.createDataFrame([(i, 0, "lin", [0], [float(a) for a in row]) for i, row in enumerate(x)], "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>")
    states = spark.createDataFrame([(i, 0, int(s)) for i, s in enumerate(y)], "graph_id bigint, var_id int, state int")
    data = instances(factor, states).coalesce(2).cache()
    for objective, method in (("ssvm", "subgradient"), ("perceptron", "sgd")):
        model, _ = train(data, Model([Type("lin", [2], data_size=2)]), objective, method, max_iter=12)
        e = x @ model.weights.reshape(2, 2).T
        assert (e.argmin(axis=1) == y).mean() > 0.85


def test_expectation_maximization_improves(chains, spark):
    factor, states, _, _ = chains
    few = factor.where("graph_id < 200")
    partly = states.where("graph_id < 200 and not (var_id = 1 and graph_id % 2 = 0)")
    data = instances(few, partly).coalesce(2).cache()
    _, values = expectation_maximization(data, Model([Type("pair", [2, 2], prior=Normal(5))], np.array([0.2, 0.1, 0.0, 0.1])), max_iter=3, inner=5)
    assert values[-1] <= values[0] + 1e-6


def test_covers_and_conditioning_sets(chains):
    """Covers of composite likelihood, rows and columns of a grid, chosen conditioning sets."""
    _, _, data, _ = chains
    model, w = Model([Type("pair", [2, 2])]), np.array([0.3, -0.2, 0.1, 0.4])
    for objective, options in (("mcle", {"cover": 2}), ("mcle", {"cover": -1}), ("mtple", {"given": [[1], [0, 2]]})):
        assert optim.gradient_error(lambda x, o=objective, k=options: evaluate(data, model, o, x, **k)[:2], w, 2) < 1e-6
    single = evaluate(data, model, "mcle", w, cover=-1)
    assert single[0] == pytest.approx(3 * evaluate(data, model, "mple", w)[0])
    both = evaluate(data, model, "mtple", w, given=[[1], [0, 2]])
    assert both[0] == pytest.approx(single[0])  # given 1 its neighbours are alone


def test_criss_cross(spark):
    rng = np.random.default_rng(2)
    pairs = [(r * 3 + c, r * 3 + c + 1) for r in range(2) for c in range(2)] + [(c, c + 3) for c in range(3)]
    factor = spark.createDataFrame([(g, k, "pair", list(p), []) for g in range(4) for k, p in enumerate(pairs)], "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>")
    states = spark.createDataFrame([(g, v, int(rng.integers(2))) for g in range(4) for v in range(6)], "graph_id bigint, var_id int, state int")
    model = Model([Type("pair", [2, 2])])
    f = lambda w: evaluate(instances(factor, states), model, "mccle", w)[:2]
    value, _ = f(np.zeros(4))
    assert value == pytest.approx(2 * 6 * math.log(2))  # each variable is in one row and one column
    assert optim.gradient_error(f, np.array([0.3, -0.2, 0.1, 0.4]), 2) < 1e-6
    with pytest.raises(Exception, match="no grid"):
        evaluate(instances(factor.where("factor_id < 6"), states), model, "mccle", np.zeros(4))


def test_simplex_quadratic():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        a = rng.normal(size=(n, 3))
        q, b = a @ a.T, rng.normal(size=n)
        x, value = optim.simplex_quadratic(q, b)
        assert x.min() >= 0 and x.sum() == pytest.approx(1) and value == pytest.approx(b @ x - x @ q @ x / 2)
        for y in rng.dirichlet(np.ones(n), size=300):
            assert b @ y - y @ q @ y / 2 <= value + 1e-8


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    factor = spark.createDataFrame([(i, 0, "lin", [0], [float(a) for a in row]) for i, row in enumerate(x)], "graph_id bigint, factor_id int, type string, vars array<int>, data array<double>")
    states = spark.createDataFrame([(i, 0, int(s)) for i, s in enumerate(y)], "graph_id bigint, var_id int, state int")
    return x, y, instances(factor, states).coalesce(2).cache()


def test_bundle_closes_the_gap(separable):
    x, y, data = separable
    model, objective, bound = bundle(data, Model([Type("lin", [2], data_size=2)]), c=5.0, tol=1e-3, max_iter=60)
    assert bound <= objective <= bound + 1e-3 * max(1, objective) + 1e-9
    assert ((x @ model.weights.reshape(2, 2).T).argmin(axis=1) == y).mean() > 0.9
    rng = np.random.default_rng(0)
    for _ in range(5):
        w = model.weights + rng.normal(size=4) * 0.3
        assert w @ w / 2 + 5 * evaluate(data, model, "ssvm", w)[0] >= bound - 1e-9
    assert train(data, Model([Type("lin", [2], data_size=2)]), "ssvm", "bmrm", tol=0.05, max_iter=30)[1] > 0


def test_mini_batches(separable):
    x, y, data = separable
    dealt = [sorted(r.graph_id for r in mini_batch(data, 3, 0, k).collect()) for k in range(3)]
    assert sorted(sum(dealt, [])) == list(range(60)) and dealt != [sorted(r.graph_id for r in mini_batch(data, 3, 1, k).collect()) for k in range(3)]
    for model in (stochastic(data, Model([Type("lin", [2], data_size=2)]), "perceptron", epochs=4, batches=3, step=0.5, average=True), stochastic(data, Model([Type("lin", [2], data_size=2)]), "cd", epochs=4, batches=3, step=0.5), sampled_perceptron(data, Model([Type("lin", [2], data_size=2)]), steps=10, per_step=20)):
        assert ((x @ model.weights.reshape(2, 2).T).argmin(axis=1) == y).mean() > 0.8


def test_rbf_types_are_learnt(separable, tmp_path):
    _, _, data = separable
    rng = np.random.default_rng(6)
    model = Model([Type("lin", [2], data_size=2, rbf_n=2)], rng.normal(size=13) * 0.5)
    f = lambda w: evaluate(data, model, "mle", w)[:2]
    assert all(optim.gradient_error(f, model.weights, seed) < 1e-6 for seed in (1, 2, 5))
    model.save(str(tmp_path / "model.json"))
    again = Model.load(str(tmp_path / "model.json"))
    assert again.types == model.types and again.weights.tolist() == model.weights.tolist()
