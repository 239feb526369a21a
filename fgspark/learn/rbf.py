"""Radial basis networks: sum over n of alpha_n exp(-exp(log_beta) |x - c_n|^2); centers from data, and regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import over
from . import optim


@dataclass
class Network:
    alpha: np.ndarray
    centers: np.ndarray
    log_beta: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        return ((x[:, None, :] - self.centers[None]) ** 2).sum(axis=2)

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-np.exp(self.log_beta) * self.distances(x)) @ self.alpha

    def slopes(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weighted sum over rows of the value's slopes in alpha, centers and log_beta, in a row."""
        beta, q = np.exp(self.log_beta), self.distances(x)
        v = np.exp(-beta * q)
        share = weight[:, None] * v * self.alpha
        centers = 2 * beta * (share[:, :, None] * (x[:, None, :] - self.centers[None])).sum(axis=0)
        return np.concatenate([weight @ v, centers.ravel(), [-beta * float((share * q).sum())]])

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([self.alpha, self.centers.ravel(), [self.log_beta]])

    @classmethod
    def of(cls, w: np.ndarray, n: int) -> Network:
        return cls(w[:n], w[n:-1].reshape(n, -1), float(w[-1]))


def centers_from_data(factor: DataFrame, observed: DataFrame, n: int, seed: int = 0, noise: float = 1e-8) -> DataFrame:
    """ei, n, center: for each entry of the table n of the data that were observed with it, in the order of a seeded hash.

    observed: graph_id, factor_id, ei. The noise, of either sign by the same hash, keeps equal centers apart. An entry with
    fewer observations has as many centers.
    """
    rows = observed.join(factor.select("graph_id", "factor_id", "data"), ["graph_id", "factor_id"])
    turn = F.md5(F.concat_ws("-", F.lit(seed), F.col("graph_id"), F.col("factor_id")))
    ranked = rows.withColumn("n", F.row_number().over(over("ei").orderBy(turn, "graph_id", "factor_id")) - 1).where(F.col("n") < n)
    jitter = lambda i: (F.pmod(F.xxhash64(turn, i), F.lit(2_000_001)) / 1e6 - 1) * noise
    return ranked.select("ei", "n", F.transform("data", lambda x, i: x + jitter(i)).alias("center"))


def fit(data: DataFrame, n_centers: int = 5, log_beta: float = 0.0, fit_beta: bool = True, max_iter: int = 100, tol: float = 1e-6, memory: int = 50) -> tuple[Network, float]:
    """Least squares (half the mean square) of y on x (columns x array<double>, y double) by L-BFGS; a job of partial sums
    gives value and slope. The first centers are n different data, in order of a hash. Returns the network and its loss."""
    rows = data.where("x is not null and y is not null")
    some = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(n_centers).collect()
    if not some:
        raise ValueError("there are no data")
    start = Network(np.zeros(len(some)), np.array([r.x for r in some], dtype=float), log_beta)
    spark, n = data.sparkSession, len(some)

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            net, count, value, grad = Network.of(shared.value, n), 0, 0.0, np.zeros(len(shared.value))
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.iloc[at : at + 4096]
                    x, y = np.array(part["x"].tolist(), dtype=float), part["y"].to_numpy(dtype=float)
                    off = net.value(x) - y
                    count, value, grad = count + len(y), value + float(off @ off) / 2, grad + net.slopes(x, off)
            yield pd.DataFrame({"n": [count], "value": [value], "g": [grad]})

        found = rows.select("x", "y").mapInPandas(run, "n long, value double, g array<double>").collect()  # a row per task
        count = sum(r.n for r in found)
        grad = np.sum([r.g for r in found], axis=0) / count
        if not fit_beta:
            grad[-1] = 0.0
        return sum(r.value for r in found) / count, grad

    w, loss = optim.lbfgs(f, start.weights, tol, max_iter, memory)
    return Network.of(w, n), loss
