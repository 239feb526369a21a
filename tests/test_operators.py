"""Table operators against golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fgspark import schema
from fgspark.functions import tables as T
from fgspark.operators import conditioning as C
from fgspark.operators import energies as E
from fgspark.operators import grouped as G
from fgspark.operators import losses as L
from fgspark.operators import structure as S
from fgspark.sources import build, fge

TYPE = "name string, kind string, card array<int>, prod_card bigint, data_size int, w array<double>, tie array<int>, rbf_n int, log_beta double"


def graph(spark, cards, factors):
    variable = spark.createDataFrame([(0, v, c) for v, c in enumerate(cards)], schema.VARIABLE)
    rows = spark.createDataFrame([(0, k, list(vs), [float(x) for x in e]) for k, (vs, e) in enumerate(factors)], "graph_id bigint, factor_id int, vars array<int>, energies array<double>")
    return variable, rows


PAIR = [((0, 1), [0, 0.3, 0.2, 0]), ((0,), [0.1, 0.7]), ((1,), [0.3, 0.6])]


def test_index_arithmetic(spark):
    df = spark.createDataFrame([([2, 3, 4], [1, 2, 3])], "c array<int>, s array<int>")
    k = T.strides(F.col("c"))
    row = df.select(k.alias("k"), T.index_of(F.col("s"), k).alias("i"), T.table_size(F.col("c")).alias("n")).first()
    assert (row.k, row.i, row.n) == ([1, 2, 6], 1 + 4 + 18, 24)
    back = df.select(*[T.digit(F.lit(23), F.lit(s), F.lit(c)).alias(f"d{s}") for s, c in ((1, 2), (2, 3), (6, 4))], T.with_digit(F.lit(23), F.lit(2), F.lit(3), F.lit(0)).alias("w")).first()
    assert tuple(back) == (1, 2, 3, 19)
    assert df.select(T.place_of(F.col("s"), F.lit(3)).alias("p"), T.place_of(F.col("s"), F.lit(9)).alias("q")).first()[:] == (2, None)


def test_log_sum_exp_is_stable(spark):
    df = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("b", -1000.0)], "k string, x double")
    assert dict(map(tuple, T.log_sum_exp(df, ["k"], "x", "y").collect())) == pytest.approx({"a": 1000 + math.log(2), "b": -1000})
    odd = spark.createDataFrame([("a", float("-inf")), ("a", 0.0), ("b", float("-inf")), ("c", None), ("c", 5.0), ("d", float("inf")), ("d", -1e300), (None, 1e300)], "k string, x double")
    assert dict(map(tuple, T.log_sum_exp(odd, ["k"], "x", "y").collect())) == {"a": 0, "b": -math.inf, "c": 5, "d": math.inf, None: pytest.approx(1e300)}
    assert T.log_sum_exp(odd.limit(0), ["k"], "x", "y").count() == 0
    assert T.log_sum_exp(df, [], "x", "y").first().y == pytest.approx(1000 + math.log(2))


def test_labeling_and_site_energies(spark):
    variable, factor = graph(spark, [2, 2], PAIR)
    energy, scope = E.energy_rows(factor), E.scopes(factor, variable)
    states = spark.createDataFrame([(0, s, v, x) for s, xs in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]) for v, x in enumerate(xs)], schema.SAMPLE)
    got = {r.sample_id: r.energy for r in E.labeling_energy(energy, scope, states, ("sample_id",)).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.4, 0.9, 1.3, 1.3])
    one = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], schema.OBS_STATE)
    sites = {(r.var_id, r.s): r.energy for r in E.site_energies(G.packed(factor, variable), one).collect()}
    assert sites == pytest.approx({(0, 0): 0.3, (0, 1): 0.7, (1, 0): 0.3, (1, 1): 0.8})


def test_linear_sparse_and_tied_energies_and_gradient(spark):
    w = [0.3, 0.5, 1.0, 0.2, 0.05, 0.6, -0.2, 0.75]
    types = spark.createDataFrame([("lin", "linear", [2, 2], 4, 2, w, None, None, None), ("tied", "tied", [2, 2], 4, 0, [-0.4], [0, -1, -1, 0], None, None), ("raw", "table", [2, 2], 4, 0, [], None, None, None), ("rbf", "rbf", [2], 2, 1, [1.0, 0.5, 2.0, -1.0], None, 1, 0.0)], TYPE)
    rows = [(0, k, "lin", [k, k + 1], d, None, None) for k, d in enumerate([[0.1, 0.2], [0.3, 0.4], [0.5, 0.6]])]
    rows += [(0, 3, "lin", [0, 1], [0.2], [1], None), (0, 4, "tied", [0, 1], [], None, None), (0, 5, "raw", [0, 1], [1.0, 2.0, 3.0, 4.0], None, None), (0, 6, "rbf", [0], [0.0], None, None)]
    factor = spark.createDataFrame(rows, schema.FACTOR)
    e = {r.factor_id: r.energies for r in E.energy_tables(factor, types).collect()}
    assert e[0] == pytest.approx([0.1 * w[2 * i] + 0.2 * w[2 * i + 1] for i in range(4)])
    assert e[3] == pytest.approx([0.2 * w[2 * i + 1] for i in range(4)])
    assert e[4] == pytest.approx([-0.4, 0, 0, -0.4])
    assert e[5] == [1, 2, 3, 4]
    assert e[6] == pytest.approx([math.exp(-0.25), 2 * math.exp(-1)])
    p = spark.createDataFrame([(0, f, i, x) for f in range(3) for i, x in enumerate([0.25, 0.4, 0.1, 0.25])], schema.MARGINAL)
    g = {r.k: r.g for r in E.weight_gradient(factor, p, types).collect()}
    assert [g[k] for k in range(8)] == pytest.approx([0.225, 0.3, 0.36, 0.48, 0.09, 0.12, 0.225, 0.3])


def test_conditioning(spark):
    variable, factor = graph(spark, [2, 2], PAIR)
    energy, scope = E.energy_rows(factor), E.scopes(factor, variable)
    seen = spark.createDataFrame([(0, 1, 0)], schema.OBS_STATE)
    cut = C.condition_on_states(energy, scope, seen).groupBy("new_ei").agg(F.sum("energy").alias("e")).collect()
    left = {r.new_ei: r.e for r in cut}
    assert left == pytest.approx({0: 0.1, 1: 1.0})
    assert math.log(sum(math.exp(-x) for x in left.values())) == pytest.approx(0.24115, abs=1e-5)
    assert C.observed_constant(energy, scope, seen).first().energy == pytest.approx(0.3)
    variable, triple = graph(spark, [2, 2, 2], [((0, 1, 2), [0, 0.3, 0.2, 0.1, 0.4, 0.5, 0.9, 0.6])])
    beliefs = spark.createDataFrame([(0, 1, 0, 0.3), (0, 1, 1, 0.7)], "graph_id bigint, var_id int, s int, p double")
    got = {r.new_ei: r.energy for r in C.condition_on_beliefs(E.energy_rows(triple), E.scopes(triple, variable), beliefs).collect()}
    z = sum(math.exp(-got[i]) for i in range(4))
    assert [math.exp(-got[i]) / z for i in range(4)] == pytest.approx([0.31505, 0.30882, 0.17118, 0.20495], abs=1e-5)


def test_grouped_inference_and_samples(spark):
    variable, factor = graph(spark, [2, 2], PAIR)
    packed = G.packed(factor, variable)
    for method in ("bfexact", "treeinf", "bp"):
        assert G.log_z(packed, method).first().log_z == pytest.approx(0.4836311, abs=1e-6)
    assert G.infer(packed, "gibbs", samples=50).first().log_z is None
    assert [r.state for r in G.infer(packed, "mapmsd").orderBy("var_id").collect()] == [0, 0]
    rows = G.sample(packed, "treeinf", 400, seed=5)
    assert rows.count() == 800
    assert G.energy_statistic(rows, rows).first().statistic == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        G.infer(packed, "nothing")


def test_structure(spark):
    variable, factor = graph(spark, [2] * 5, [((0, 1), [0] * 4), ((1, 2), [0] * 4), ((0, 2), [0] * 4), ((3, 4), [0] * 4)])
    scope = E.scopes(factor, variable)
    assert {r.var_id: r.component for r in S.components(scope, variable).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert S.shape(scope, variable).first()[1:] == (2, False, False, False)
    removed = spark.createDataFrame([(0, 2)], "graph_id bigint, factor_id int")
    assert S.shape(scope, variable, removed).first().is_forest
    variable, factor = graph(spark, [2] * 6, [((a, b), [0] * 4) for a, b in ((0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5))])
    assert S.grid_shape(E.scopes(factor, variable)).first()[1:] == (2, 3)
    assert {r.var_id: r.depth for r in S.depths(E.scopes(factor, variable), variable).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 5: 3}
    part = S.sub_graph(factor, spark.createDataFrame([(0, 3, 0.5)], "graph_id bigint, factor_id int, scale double")).first()
    assert part.vars == [0, 1]
    assert S.neighbours(E.scopes(factor, variable)).where("var_id = 4").first().factors == [2, 3, 5]


def test_files(spark, tmp_path):
    variable, factor = graph(spark, [2, 2], PAIR)
    text = fge.lines(factor, variable).first().text
    assert text.split("\n")[:5] == ["2", "2 2", "3", "2 1 2", "0.0000000000 0.3000000000 0.2000000000 0.0000000000"]
    (tmp_path / "g.fge").write_text(text)
    v, f = fge.read(spark, str(tmp_path / "g.fge"))
    assert [(r.vars, r.energies) for r in f.orderBy("factor_id").collect()] == [(list(a), [float(x) for x in b]) for a, b in PAIR]
    assert v.count() == 2
    fge.save({"variable": variable}, str(tmp_path / "t"))
    assert fge.load(spark, str(tmp_path / "t"), {"variable": schema.VARIABLE})["variable"].count() == 2


def test_validator(spark):
    types = spark.createDataFrame([("a", "linear", [2, 2], 4, 1, [0.0] * 4, None, None, None)], TYPE)
    variable = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (0, 2, 2)], schema.VARIABLE)
    factor = spark.createDataFrame([(0, 0, "a", [0, 1], [float("nan")], None, None), (0, 1, "b", [0], [2e4], None, None), (0, 2, "a", [0], [1.0], None, None), (0, 3, "a", [0, 9], [1.0], None, None)], schema.FACTOR)
    got = {(r.factor_id, r.var_id, r.problem) for r in E.violations(factor, variable, types).collect()}
    assert got == {(0, None, "data not finite"), (1, None, "data very large"), (1, None, "unknown type"), (2, None, "number of variables"), (0, 1, "cardinality"), (3, 9, "unknown variable"), (None, 2, "isolated variable")}


def test_energy_statistic_pairs_distinct_samples_only(spark):
    """2000 samples of 4 kinds on each side: as by all pairs, with no more than 16 pairs a mean."""
    rng = np.random.default_rng(8)
    p, q = (rng.choice(2, size=(2000, 2), p=w) for w in ([0.7, 0.3], [0.4, 0.6]))
    frame = lambda x: spark.createDataFrame([(0, i, v, int(s)) for i, r in enumerate(x) for v, s in enumerate(r)], "graph_id long, sample_id long, var_id int, state int").repartition(2)
    mean = lambda a, b: np.sqrt((a[:, None] != b[None]).sum(axis=2)).mean()
    found = G.energy_statistic(frame(p), frame(q))
    assert found.first().statistic == pytest.approx(2 * mean(p, q) - mean(p, p) - mean(q, q), abs=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(1)") == 6  # both sides of the three means are counted before they are paired


def test_beliefs_of_zero_and_missing_states(spark):
    variable, factor = graph(spark, [2, 2], [((0, 1), [1.0, 2.0, 11.0, 22.0])])
    for rows in ([(0, 1, 0, 1.0), (0, 1, 1, 0.0)], [(0, 1, 0, 1.0)]):
        beliefs = spark.createDataFrame(rows, C.BELIEFS)
        got = C.condition_on_beliefs(E.energy_rows(factor), E.scopes(factor, variable), beliefs).orderBy("new_ei").collect()
        assert [r.energy for r in got] == [1, 2]


def test_conditioned_graph_and_back(spark):
    """Marginals given variable 2 come back as those of the whole model with that state."""
    tables = [((0, 1), [0.1, 0.7, 0.3, 0.2]), ((1, 2), [0.5, 0.1, 0.9, 0.4]), ((2,), [0.3, 0.6]), ((2, 3), [0.2, 0.8, 0.1, 0.6])]
    variable, factor = graph(spark, [2] * 4, tables)
    seen = spark.createDataFrame([(0, 2, 1)], C.STATES)
    made = C.conditioned_graph(factor, variable, seen)
    assert sorted(map(tuple, made["var_map"].collect())) == [(0, 0, 0), (0, 1, 1), (0, 2, 3)]
    assert sorted((r.factor_id, r.old_factor_id) for r in made["factor_map"].collect()) == [(0, 0), (1, 1), (2, 3)]
    assert made["constant"].first().energy == pytest.approx(0.6)
    found = G.infer(made["tables"], "bfexact").join(made["factor_map"], ["graph_id", "factor_id"]).select("graph_id", F.col("old_factor_id").alias("factor_id"), "ei", "p")
    scope, energy = E.scopes(factor, variable), E.energy_rows(factor)
    whole = C.extend_marginals(found, energy, scope, seen)
    held = factor.unionByName(spark.createDataFrame([(0, 4, [2], [100.0, 0.0])], factor.schema))
    want = {(r.factor_id, r.ei): r.p for r in G.infer(G.packed(held, variable), "bfexact").where("factor_id < 4").collect()}
    assert {(r.factor_id, r.ei): r.p for r in whole.collect()} == pytest.approx(want, abs=1e-9)
    known = {(r.factor_id, r.cond_ei): r.p for r in C.project_known(C.extend_marginals(found, energy, scope, seen, replicate=True), scope, seen).collect()}
    assert set(known) == {(f, c) for f in (1, 2, 3) for c in (0, 1)} and known[1, 0] == pytest.approx(known[1, 1])
    kinds = C.conditioned_types(spark.createDataFrame([(0, 0, "p", [0, 1]), (0, 1, "p", [1, 2]), (0, 2, "p", [3, 2]), (0, 3, "u", [2])], "graph_id long, factor_id int, type string, vars array<int>"), seen)
    assert [tuple(r) for r in kinds.collect()] == [("p", [1], 2)]


def test_builders_and_data_sources(spark, tmp_path):
    types = build.model(spark, [build.linear("lin", [2], [[1.0, 2.0], [3.0, 4.0]]), build.table("own", [2]), build.tied("t", [2, 2], [0, -1, -1, 0], [0.5]), build.rbf_net("r", [2], [[1.0], [2.0]], [[[0.5]], [[-1.0]]], 0.0)])
    build.save_model(types, str(tmp_path / "m"))
    assert sorted(map(tuple, build.load_model(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, types.collect()))
    factor = build.by_number(spark.createDataFrame([(0, 0, 1, [0], 7, None), (0, 1, 1, [1], 7, None), (0, 2, 2, [0], None, [4.0, 5.0])], "graph_id long, factor_id int, type int, vars array<int>, dsrc_id int, data array<double>"), types, ["lin", "own"])
    sources = spark.createDataFrame([(0, 7, [1.0, 10.0])], "graph_id long, dsrc_id int, data array<double>")
    e = {r.factor_id: r.energies for r in E.energy_tables(build.with_sources(factor, sources), types).collect()}
    assert e == {0: [21, 43], 1: [21, 43], 2: [4, 5]}
    for bad in (factor.withColumn("data", F.array(F.lit(1.0))), factor.withColumn("dsrc_id", F.lit(8))):
        with pytest.raises(Exception, match="data source"):
            build.with_sources(bad, sources).collect()
    with pytest.raises(ValueError):
        build.model(spark, [build.table("a", [2]), build.table("a", [3])])
    with pytest.raises(ValueError):
        build.linear("a", [2], [[1.0]])


def test_losses(spark):
    variable, factor = graph(spark, [2, 2], PAIR)
    seen = spark.createDataFrame([(0, 0, 1, 2.0), (0, 1, 0, 0.5)], "graph_id bigint, var_id int, state int, penalty double")
    found = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], C.STATES)
    assert L.hamming(seen, found).first().loss == 2 and L.hamming(found, seen.drop("penalty")).first().loss == 1
    harder = L.loss_augmented(factor, E.scopes(factor, variable), seen, -1.0)
    got = {tuple(r.vars): r.energies for r in harder.collect()}
    assert got[0, 1] == pytest.approx([0 - 2, 0.3, 0.2 - 2 - 0.5, 0 - 0.5]) and got[(0,)] == [0.1, 0.7]


def test_rbf_slopes(spark):
    """Against differences of the energies."""
    rng = np.random.default_rng(4)
    w = rng.normal(size=2 * 2 * 4)
    types = lambda v, b: spark.createDataFrame([("r", "rbf", [2], 2, 3, [float(x) for x in v], None, 2, float(b))], TYPE)
    factor = spark.createDataFrame([(0, 0, "r", [0], [float(x) for x in rng.normal(size=3)], None, None), (1, 0, "r", [0], [float(x) for x in rng.normal(size=3)], None, None)], schema.FACTOR)
    p = spark.createDataFrame([(g, 0, s, q) for g in (0, 1) for s, q in enumerate((0.3, 0.7))], schema.MARGINAL)
    value = lambda v, b: E.expected_energy(E.energy_rows(E.energy_tables(factor, types(v, b))), p).agg(F.sum("energy")).first()[0]
    got = {r.k: r.g for r in E.weight_gradient(factor, p, types(w, 0.2)).collect()}
    assert len(got) == 17
    for k in (0, 3, 9, 15):
        step = np.eye(16)[k] * 1e-5
        assert got[k] == pytest.approx((value(w + step, 0.2) - value(w - step, 0.2)) / 2e-5, abs=1e-6)
    assert got[-1] == pytest.approx((value(w, 0.2 + 1e-5) - value(w, 0.2 - 1e-5)) / 2e-5, abs=1e-6)


def test_validator_of_sizes_and_states(spark):
    types = spark.createDataFrame([("a", "linear", [2], 2, 2, [0.0] * 4, None, None, None), ("b", "linear", [2], 2, 2, [0.0] * 3, None, None, None), ("c", "table", [2], 2, 0, [], None, None, None)], TYPE)
    variable = spark.createDataFrame([(0, 0, 2)], schema.VARIABLE)
    factor = spark.createDataFrame([(0, 0, "a", [0], [1.0], None, None), (0, 1, "b", [0], [1.0, 2.0], None, None), (0, 2, "c", [0], [1.0], None, None), (0, 3, "a", [0], [], [], None), (0, 4, "a", [0], [1.0], [1, 0], None), (0, 5, "a", [0], [1.0], [1], None)], schema.FACTOR)
    states = spark.createDataFrame([(0, 0, 2)], C.STATES)
    got = {(r.factor_id, r.var_id, r.problem) for r in E.violations(factor, variable, types, states=states).collect()}
    assert got == {(0, None, "number of data"), (1, None, "number of weights"), (2, None, "size of the energy table"), (3, None, "empty sparse data"), (4, None, "number of data"), (None, 0, "state out of range")}
