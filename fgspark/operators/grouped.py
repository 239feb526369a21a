"""Inference, sampling and comparison of many graphs: one grouped task per graph runs a numpy kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..kernels import approximate, exact, sampling
from ..kernels.decompose import acyclic_greedy
from ..kernels.graph import Graph, Result
from . import energies as E

#: Methods of infer(): name -> (kernel, whether it gives a labeling).
MARGINAL_METHODS = {
    "bfexact": lambda g, **o: exact.enumerate_all(g),
    "treeinf": lambda g, **o: exact.Forest(g).infer(),
    "bp": lambda g, **o: approximate.belief_propagation(g, **o),
    "nmf": lambda g, **o: approximate.mean_field(g, **o),
    "smf": lambda g, **o: approximate.structured_mean_field(g, acyclic_cut(g), **o),
    "gibbs": lambda g, **o: sampling.gibbs(g, **o),
    "mcgibbs": lambda g, **o: sampling.multichain_gibbs(g, **o),
    "ais": lambda g, **o: sampling.annealed_importance(g, **o),
    "pt": lambda g, **o: sampling.parallel_tempering(g, **o)[0],
    "samc": lambda g, **o: sampling.stochastic_approximation(g, **o)[0],
    "spdiff": lambda g, **o: approximate.sum_product_diffusion(g, **o),
    "sw": lambda g, **o: sampling.swendsen_wang(g, **o),
}
MAP_METHODS = {
    "mapbfexact": lambda g, **o: exact.enumerate_map(g),
    "maptree": lambda g, **o: exact.Forest(g).map(),
    "mapbp": lambda g, **o: approximate.belief_propagation(g, minimum=True, **o),
    "mapmsd": lambda g, **o: approximate.min_sum_diffusion(g, **o)[:2],
    "maplp": lambda g, **o: approximate.dual_decomposition_map(g, **o)[:2],
    "mapsa": lambda g, **o: sampling.simulated_annealing(g, **o),
}
#: Lower bounds by which a method's labeling is proven, for those that do without min-sum diffusion's.
BOUNDS = {"maplp": lambda g: approximate.dual_decomposition_map(g)[2]}


def acyclic_cut(graph: Graph) -> set[int]:
    """Factors to leave out so that the rest are trees without a left-out factor inside; those of most spread stay first."""
    return acyclic_greedy(graph, [float(np.ptp(t)) for _, t in graph.factors])


def _graph(rows: pd.DataFrame) -> tuple[Graph, list[int], list[int]]:
    """(graph, its variable ids, its factor ids) of rows of packed()."""
    rows = rows.sort_values("factor_id")
    cards: dict[int, int] = {}
    for vs, cs in zip(rows["vars"], rows["cards"]):
        cards.update(zip(map(int, vs), map(int, cs)))
    ids = sorted(cards)
    new = {v: i for i, v in enumerate(ids)}
    return Graph.of([cards[v] for v in ids], [([new[int(v)] for v in vs], e) for vs, e in zip(rows["vars"], rows["energies"])]), ids, rows["factor_id"].astype(int).tolist()


def packed(tables: DataFrame, variable: DataFrame) -> DataFrame:
    """A row per factor: graph_id, factor_id, vars, cards, energies; from energy_tables(), whose `cards` are taken if they are there."""
    if "cards" in tables.columns:
        return tables.select("graph_id", "factor_id", "vars", "cards", "energies")
    at = tables.select("graph_id", "factor_id", F.posexplode("vars").alias("pos", "var_id")).join(variable, ["graph_id", "var_id"])
    cards = at.groupBy("graph_id", "factor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "card"))), lambda x: x["card"]).alias("cards"))
    return tables.join(cards, ["graph_id", "factor_id"]).select("graph_id", "factor_id", "vars", "cards", "energies")


def infer(graphs: DataFrame, method: str, proven: bool = False, **options) -> DataFrame:
    """graphs: rows of packed(). Marginals come as graph_id, factor_id, ei, p, log_z (null where a method has none);
    labelings (methods map...) as graph_id, var_id, state, energy. A graph must fit in one task.

    proven: a labeling goes on by branch and bound till none is better (of equal ones the first with the smallest variable
    fastest), which takes long on large graphs where the method's bounds are loose."""
    if method in MAP_METHODS:

        def label(rows: pd.DataFrame) -> pd.DataFrame:
            graph, ids, _ = _graph(rows)
            state, energy = MAP_METHODS[method](graph, **options)
            if proven:
                state, energy = approximate.proven_map(graph, state, *([BOUNDS[method]] if method in BOUNDS else []))
            return pd.DataFrame({"graph_id": rows["graph_id"].iloc[0], "var_id": ids, "state": state, "energy": energy})

        return graphs.groupBy("graph_id").applyInPandas(label, schema.STATE)
    if method not in MARGINAL_METHODS:
        raise ValueError(f"unknown method {method}")

    def marginals(rows: pd.DataFrame) -> pd.DataFrame:
        graph, _, factors = _graph(rows)
        result: Result = MARGINAL_METHODS[method](graph, **options)
        flat = [m.ravel(order="F") for m in result.marginals]
        return pd.DataFrame(
            {
                "graph_id": rows["graph_id"].iloc[0],
                "factor_id": np.repeat(factors, [len(m) for m in flat]),
                "ei": np.concatenate([np.arange(len(m)) for m in flat]),
                "p": np.concatenate(flat),
                "log_z": np.nan if result.log_z is None else result.log_z,
            }
        )

    out = graphs.groupBy("graph_id").applyInPandas(marginals, schema.MARGINAL + ", log_z double")
    return out.withColumn("log_z", F.when(~F.isnan("log_z"), F.col("log_z")))


def log_z(graphs: DataFrame, method: str = "treeinf", **options) -> DataFrame:
    """graph_id, log_z."""
    return infer(graphs, method, **options).groupBy("graph_id").agg(F.max("log_z").alias("log_z"))


def sample(graphs: DataFrame, method: str, n: int, seed: int = 0, **options) -> DataFrame:
    """graph_id, sample_id, var_id, state: by "treeinf" (exact, forests) or "gibbs"."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        graph, ids, _ = _graph(rows)
        own = (seed * 1_000_003 + int(rows["graph_id"].iloc[0])) % (1 << 31)
        found = exact.Forest(graph).sample(n, np.random.default_rng(own)) if method == "treeinf" else sampling.gibbs_samples(graph, n, seed=own, **options)
        return pd.DataFrame({"graph_id": rows["graph_id"].iloc[0], "sample_id": np.repeat(np.arange(n), len(ids)), "var_id": np.tile(ids, n), "state": found.ravel()})

    if method not in ("treeinf", "gibbs"):
        raise ValueError(f"unknown method {method}")
    return graphs.groupBy("graph_id").applyInPandas(draw, schema.SAMPLE)


def divergence(energy_p: DataFrame, log_z_p: DataFrame, energy_q: DataFrame, log_z_q: DataFrame, marginal_q: DataFrame) -> DataFrame:
    """graph_id, kl of q from p, of two models on the same factors: E_q[E_p] + log Z_p - E_q[E_q] - log Z_q."""
    gap = energy_p.select("graph_id", "factor_id", "ei", F.col("energy").alias("ep")).join(energy_q, ["graph_id", "factor_id", "ei"]).join(marginal_q, ["graph_id", "factor_id", "ei"])
    mean = gap.groupBy("graph_id").agg(F.sum(F.col("p") * (F.col("ep") - F.col("energy"))).alias("d"))
    return mean.join(log_z_p.withColumnRenamed("log_z", "zp"), "graph_id").join(log_z_q.withColumnRenamed("log_z", "zq"), "graph_id").select("graph_id", (F.col("d") + F.col("zp") - F.col("zq")).alias("kl"))


def energy_statistic(p: DataFrame, q: DataFrame) -> DataFrame:
    """graph_id, statistic, coefficient: 2 E|p - q| - E|p - p'| - E|q - q'| of two sample sets, the distance the root of the
    Hamming distance; the coefficient is its share of 2 E|p - q| (0 where that is 0).

    Equal samples of a graph are counted first; only distinct ones are paired, and weigh as often as they occur.
    """
    pack = lambda s: s.groupBy("graph_id", "sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("var_id", "state"))), lambda x: x["state"]).alias("x"))
    count = lambda s, n: pack(s).groupBy("graph_id", F.col("x").alias(f"x{n}")).agg(F.count("*").cast("double").alias(f"n{n}"))

    def mean(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        pairs = count(a, 1).join(count(b, 2), "graph_id")
        unequal = F.aggregate(F.zip_with("x1", "x2", lambda u, v: (u != v).cast("int")), F.lit(0), lambda s, x: s + x)
        weighed = pairs.select("graph_id", (F.col("n1") * F.col("n2")).alias("n"), F.sqrt(unequal.cast("double")).alias("d")).where("d IS NOT NULL")
        return weighed.groupBy("graph_id").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias(name))

    return mean(p, q, "pq").join(mean(p, p, "pp"), "graph_id").join(mean(q, q, "qq"), "graph_id").select("graph_id", _excess().alias("statistic"), F.when(F.col("pq") > 0, _excess() / (2 * F.col("pq"))).otherwise(0.0).alias("coefficient"))


def _excess() -> Column:
    return 2 * F.col("pq") - F.col("pp") - F.col("qq")


def sampled_divergence(energy_p: DataFrame, scope_p: DataFrame, log_z_p: DataFrame, energy_q: DataFrame, scope_q: DataFrame, log_z_q: DataFrame, samples_q: DataFrame) -> DataFrame:
    """graph_id, kl of q from p by samples of q (graph_id, sample_id, var_id, state): mean of E_p - E_q, plus log Z_p - log Z_q."""
    keys = ("graph_id", "sample_id")
    p, q = (E.labeling_energy(e, s, samples_q, keys).withColumnRenamed("energy", n) for e, s, n in ((energy_p, scope_p, "ep"), (energy_q, scope_q, "eq")))
    mean = p.join(q, list(keys)).groupBy("graph_id").agg(F.avg(F.col("ep") - F.col("eq")).alias("d"))
    both = mean.join(log_z_p.withColumnRenamed("log_z", "zp"), "graph_id").join(log_z_q.withColumnRenamed("log_z", "zq"), "graph_id")
    return both.select("graph_id", (F.col("d") + F.col("zp") - F.col("zq")).alias("kl"))
