"""Losses between labelings that add up over variables, and graphs whose energies hold them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import digit


class Loss(Protocol):
    """A symmetric loss of a labeling against the observed one that goes into the factors' tables."""

    def evaluate(self, observed: DataFrame, found: DataFrame) -> DataFrame:
        """graph_id, loss."""
        ...

    def augment(self, tables: DataFrame, scope: DataFrame, observed: DataFrame, scale: float) -> DataFrame:
        """The tables with scale times the loss added."""
        ...


def hamming(observed: DataFrame, found: DataFrame) -> DataFrame:
    """graph_id, loss: the penalties (1 where observed has none) of the variables whose found state is another one."""
    penalty = F.col("penalty") if "penalty" in observed.columns else F.lit(1.0)
    both = observed.select("graph_id", "var_id", F.col("state").alias("true"), penalty.alias("penalty")).join(found, ["graph_id", "var_id"])
    return both.groupBy("graph_id").agg(F.sum(F.when(F.col("true") != F.col("state"), F.col("penalty")).otherwise(F.lit(0.0))).alias("loss"))


def loss_augmented(tables: DataFrame, scope: DataFrame, observed: DataFrame, scale: float = -1.0) -> DataFrame:
    """tables with scale * penalty added, for each variable, to its first factor's cells in which it has another state than
    the observed one (graph_id, var_id, state, and maybe penalty). graph_id, factor_id, vars, energies."""
    penalty = F.col("penalty") if "penalty" in observed.columns else F.lit(1.0)
    first = scope.groupBy("graph_id", "var_id").agg(F.min("factor_id").alias("factor_id"))
    at = scope.join(first, ["graph_id", "var_id", "factor_id"]).join(observed.select("graph_id", "var_id", "state", penalty.alias("penalty")), ["graph_id", "var_id"])
    marks = at.groupBy("graph_id", "factor_id").agg(F.collect_list(F.struct("card", "stride", "state", "penalty")).alias("m"))
    rows = tables.select("graph_id", "factor_id", "vars", "energies").join(marks, ["graph_id", "factor_id"], "left")
    miss = lambda m, i: F.when(digit(i.cast("bigint"), m["stride"], m["card"]) != m["state"], m["penalty"]).otherwise(F.lit(0.0))
    added = F.transform("energies", lambda e, i: e + scale * F.aggregate("m", F.lit(0.0), lambda a, m: a + miss(m, i)))
    return rows.select("graph_id", "factor_id", "vars", F.when(F.col("m").isNull(), F.col("energies")).otherwise(added).alias("energies"))


class Hamming:
    """The Loss of states that differ, each by its penalty."""

    evaluate = staticmethod(hamming)
    augment = staticmethod(loss_augmented)
