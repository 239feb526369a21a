"""Exact inference on large forests as joins: rounds of parallel elimination forwards, marginals back.

Each round takes an independent set of variables with at most two neighbours out of the graph: a variable without one
adds to log Z, one with a single neighbour adds a message to it, one with two leaves a pair table between them. Every
forest has many such variables, so the rounds grow with the logarithm of its size, a chain of any length included; so do
those of loopy graphs that such steps take apart (treewidth 2). Backwards, each variable's distribution given its
neighbours at that time turns their joint distribution into its own.

Where log Z alone is asked for, a first round takes out more: variables are dealt in blocks of consecutive numbers, and
a task takes all that it can out of each block, but for variables with neighbours in other blocks. What a block leaves
goes through the rounds of joins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import grouped

KEYS = ["graph_id", "var_id"]
#: Variables that are left when the rest of all graphs goes to the grouped method, a graph a task.
FINISH = 10_000
#: A block of the first round has 2^BLOCK_BITS consecutive variable numbers of a graph.
BLOCK_BITS = 10
_PARTS = "graph_id long, block long, kind int, a int, b int, ca int, cb int, t array<double>"


def _lse(x: Column) -> Column:
    once = lambda v, use: F.transform(F.array(v), use)[0]
    return once(F.array_max(x), lambda top: F.when(top == float("-inf"), top).otherwise(top + F.log(F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top)))))


def _states(card: Column) -> Column:
    return F.sequence(F.lit(0), card.cast("int") - 1)


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def _summed(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Arrays added up by keys; sums combine before the shuffle, place by place."""
    placed = rows.select(*keys, F.posexplode(column).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.sum("__x").alias("__x"))
    return placed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__x"))), lambda x: x["__x"]).alias(column))


def _turned(t: Column, ca: Column, cb: Column) -> Column:
    """A table over (a, b), a fastest, as one over (b, a)."""
    return F.transform(_states(ca * cb), lambda k: F.get(t, (F.floor(k / cb) + (k % cb) * ca).cast("int")))


def _start(tables: DataFrame, variable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: graph_id, var_id, card, u; edges: graph_id, a, b, ca, cb, t with a < b), scores (energies with a minus)."""
    rows = grouped.packed(tables, variable).withColumn("t", F.transform("energies", lambda e: -e))
    if rows.where(F.size("vars") > 2).limit(1).count():
        raise ValueError("factors of one and two variables are needed")
    one = rows.where(F.size("vars") == 1).select("graph_id", F.get("vars", F.lit(0)).alias("var_id"), "t")
    nodes = variable.join(_summed(one, KEYS, "t"), KEYS, "left").select(*KEYS, "card", F.coalesce("t", F.array_repeat(F.lit(0.0), F.col("card").cast("int"))).alias("u"))
    a, b, ca, cb = (F.get(c, F.lit(i)) for c in ("vars", "cards") for i in (0, 1))
    two = rows.where(F.size("vars") == 2).select("graph_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a < b, ca).otherwise(cb).alias("ca"), F.when(a < b, cb).otherwise(ca).alias("cb"), F.when(a < b, F.col("t")).otherwise(_turned(F.col("t"), ca, cb)).alias("t"))
    return nodes, _merged(two)


def _lse_last(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1)
    with np.errstate(divide="ignore"):
        return np.where(np.isneginf(top), top, np.log(np.exp(x - np.where(np.isneginf(top), 0.0, top)[..., None]).sum(axis=-1)) + top)


class _Block:
    """The scores of a block's variables and of its pairs, which are taken out one by one."""

    def __init__(self) -> None:
        self.own: dict[int, np.ndarray] = {}
        self.near: dict[int, dict[int, np.ndarray]] = {}  # near[v][w]: a row per state of w, v's states along it
        self.held: set[int] = set()
        self.across: list[tuple] = []

    def add(self, kind: int, a: int, b: int, ca: int, cb: int, t: np.ndarray) -> None:
        if kind >= 3:
            self.held.add(a)
            if kind == 5:
                self.across.append((kind, a, b, ca, cb, t))
        elif kind == 2:
            self.link(a, b, t.reshape(cb, ca))
        else:
            self.own[a] = self.own[a] + t if a in self.own else t

    def link(self, a: int, b: int, t: np.ndarray) -> None:
        """t: a row per state of b."""
        of_a, of_b = self.near.setdefault(a, {}), self.near.setdefault(b, {})
        of_a[b] = of_a[b] + t if b in of_a else t
        of_b[a] = of_a[b].T

    def rest(self) -> tuple[float | None, list[tuple]]:
        """(sum of the constants, None if there is none; variables and pairs that stay, as rows from kind on)."""
        constant, line = None, sorted(self.own.keys() - self.held, reverse=True)
        while line:
            v = line.pop()
            links = self.near.get(v, {})
            if v not in self.own or len(links) > 2:
                continue  # gone, or to come again when it has lost a neighbour
            u = self.own.pop(v)
            self.near.pop(v, None)
            for w in links:
                del self.near[w][v]
            if not links:
                constant = (constant or 0.0) + float(_lse_last(u))
            elif len(links) == 1:
                ((w, x),) = links.items()
                self.own[w] = self.own[w] + _lse_last(x + u)
            else:
                (w, x), (y, z) = links.items()
                self.link(w, y, _lse_last(z[:, None, :] + (x + u)[None, :, :]))
            line += [w for w in links if w not in self.held and len(self.near[w]) <= 2]
        ones = [(0, v, v, len(u), 1, u) for v, u in self.own.items()]
        return constant, self.across + ones + [(2, a, b, t.shape[1], t.shape[0], t.ravel()) for a, x in self.near.items() for b, t in x.items() if a < b]


def _without_inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _PARTS, sorted by graph and block: kind 0 a variable, 1 a score of its states, 2 a pair, 3 one to be held,
    5 a pair of two blocks, in that of its first. Returns variables and pairs that stay (0, 2, 5), and constants (4)."""
    at, block, out = None, _Block(), []

    def done() -> list[tuple]:
        constant, rows = block.rest()
        return [(*at, *r) for r in rows] + ([(*at, 4, 0, 0, 1, 1, np.array([constant]))] if constant is not None else [])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(r[-1]) for r in rows)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0), *(r[-1] for r in rows)])))
        types = [pa.int64()] * 2 + [pa.int32()] * 5
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(types)), lists], names=["graph_id", "block", "kind", "a", "b", "ca", "cb", "t"])

    for batch in batches:
        t = batch.column(7)
        values, ends = t.values.to_numpy(), t.offsets.to_numpy()
        for g, k, kind, a, b, ca, cb, start, end in zip(*(batch.column(i).to_pylist() for i in range(7)), ends[:-1].tolist(), ends[1:].tolist()):
            if (g, k) != at:
                if at is not None:
                    out += done()
                at, block = (g, k), _Block()
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            block.add(kind, a, b, ca, cb, values[start:end] if kind else np.zeros(ca))
    yield batch_of(out + (done() if at is not None else []))


def _blocks_out(tables: DataFrame, variable: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What _start() gives, after the round of blocks, and its constants: graph_id, z."""
    first, second = F.get("vars", F.lit(0)), F.get("vars", F.lit(1))
    ca, cb = F.get("cards", F.lit(0)), F.get("cards", F.lit(1))
    minus = F.when(F.size("vars").between(1, 2), F.transform("energies", lambda e: -e)).otherwise(F.raise_error(F.lit("factors of one and two variables are needed")).cast("array<double>"))
    block = lambda v: F.shiftright(v.cast("long"), BLOCK_BITS)
    none, one = F.expr("cast(array() as array<double>)"), F.lit(1)

    def part(kind: int | Column, a: Column, b: Column, ca: Column, cb: Column, t: Column) -> Column:
        numbers = zip(("kind", "a", "b", "ca", "cb"), (F.lit(kind) if isinstance(kind, int) else kind, a, b, ca, cb))
        return F.struct(block(a).alias("block"), *[c.cast("int").alias(name) for name, c in numbers], t.alias("t"))

    single = F.array(part(1, first, first, ca, one, minus))
    inner = F.array(part(2, first, second, ca, cb, minus))
    across = F.array(part(5, first, second, ca, cb, minus), part(3, second, second, one, one, none))
    own = F.when(second.isNull(), single).when(block(first) == block(second), inner).otherwise(across)
    graph = F.col("graph_id").cast("long").alias("graph_id")
    parts = grouped.packed(tables, variable).select(graph, F.explode(own).alias("x")).select("graph_id", "x.*")
    parts = parts.unionByName(variable.select(graph, part(0, F.col("var_id"), F.col("var_id"), F.col("card"), one, none).alias("x")).select("graph_id", "x.*"))
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = cut_lineage(parts.repartition(n, "graph_id", "block").sortWithinPartitions("graph_id", "block", "kind").mapInArrow(_without_inner, _PARTS))
    nodes = left.where("kind = 0").select("graph_id", F.col("a").alias("var_id"), F.col("ca").alias("card"), F.col("t").alias("u"))
    v, w, cv, cw = (F.col(c) for c in ("a", "b", "ca", "cb"))
    wide = left.where("kind = 5").select("graph_id", F.least(v, w).alias("v"), F.greatest(v, w).alias("w"), F.when(v < w, cv).otherwise(cw).alias("cv"), F.when(v < w, cw).otherwise(cv).alias("cw"), F.when(v < w, F.col("t")).otherwise(_turned(F.col("t"), cv, cw)).alias("s"))
    edges = _merged(left.where("kind = 2").select("graph_id", "a", "b", "ca", "cb", "t").union(wide))
    return nodes, edges, left.where("kind = 4").select("graph_id", F.get("t", F.lit(0)).alias("z"))


def _merged(edges: DataFrame) -> DataFrame:
    return _summed(edges, ["graph_id", "a", "b", "ca", "cb"], "t")


def _chosen(nodes: DataFrame, both: DataFrame, step: int) -> DataFrame:
    """graph_id, var_id: variables of at most two neighbours whose hash is the least among neighbours of that kind."""
    degree = both.groupBy("graph_id", F.col("v").alias("var_id")).agg(F.count("*").alias("n"))
    able = nodes.join(degree, KEYS, "left").where(F.coalesce("n", F.lit(0)) <= 2).select(*KEYS, F.struct(F.xxhash64(*KEYS, F.lit(step)).alias("h"), "var_id").alias("turn"))
    near = both.join(able.withColumnRenamed("var_id", "w"), ["graph_id", "w"]).groupBy("graph_id", F.col("v").alias("var_id")).agg(F.min("turn").alias("other"))
    return able.join(near, KEYS, "left").where(F.col("other").isNull() | (F.col("turn") < F.col("other"))).select(*KEYS)


def _eliminated(nodes: DataFrame, both: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen variables with their tables: graph_id, var_id, card, u, e (their edges: w, cw, t with the variable fastest)."""
    listed = both.join(chosen.withColumnRenamed("var_id", "v"), ["graph_id", "v"]).groupBy("graph_id", F.col("v").alias("var_id")).agg(F.sort_array(F.collect_list(F.struct("w", "cw", "t"))).alias("e"))
    return nodes.join(chosen, KEYS).join(listed, KEYS, "left").select(*KEYS, "card", "u", "e")


def _scores(i: Column, j: Column | None = None) -> Column:
    """Scores of the eliminated variable's states with its first neighbour in state i (and its second in j)."""
    x = lambda k, s, at: F.get(F.get("e", F.lit(k))["t"], (s + F.col("card") * at).cast("int"))
    return F.transform(_states(F.col("card")), lambda s: F.get("u", s) + x(0, s, i) + (x(1, s, j) if j is not None else F.lit(0.0)))


def _pairs() -> Column:
    return _states(F.get("e", F.lit(0))["cw"] * F.get("e", F.lit(1))["cw"])


def _at(k: Column) -> tuple[Column, Column]:
    first = F.get("e", F.lit(0))["cw"]
    return k % first, F.floor(k / first).cast("int")


def infer(tables: DataFrame, variable: DataFrame, finish: int = FINISH, marginals: bool = True, most_rounds: int = 200) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(log Z: graph_id, log_z; marginals of variables: graph_id, var_id, s, p; of pairs: graph_id, a, b, ei, p with a < b,
    a fastest, for each pair that a factor joins).

    tables: graph_id, factor_id, vars, energies, of one or two variables each. When at most `finish` variables are left
    the rest goes to the grouped exact method, whose graphs have to be forests; 0 goes on to the end. Graphs that
    elimination by two neighbours can't take apart raise an error.
    """
    if marginals:
        (nodes, edges), constants = _start(tables, variable), []
    else:
        nodes, edges, constant = _blocks_out(tables, variable)
        constants = [constant]
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    given, past = edges.select("graph_id", "a", "b"), []
    for step in range(most_rounds):
        left = nodes.count()
        if left <= finish:
            break
        both = edges.select("graph_id", F.col("a").alias("v"), F.col("b").alias("w"), F.col("cb").alias("cw"), "t").unionByName(edges.select("graph_id", F.col("b").alias("v"), F.col("a").alias("w"), F.col("ca").alias("cw"), _turned(F.col("t"), F.col("ca"), F.col("cb")).alias("t")))
        chosen = cut_lineage(_chosen(nodes, both, step))
        gone = cut_lineage(_eliminated(nodes, both, chosen))
        past.append(gone)
        size = F.coalesce(F.size("e"), F.lit(0))
        constants.append(gone.where(size <= 0).select("graph_id", _lse(F.col("u")).alias("z")))
        sent = gone.where(size == 1).select("graph_id", F.get("e", F.lit(0))["w"].alias("var_id"), F.transform(_states(F.get("e", F.lit(0))["cw"]), lambda i: _lse(_scores(i))).alias("m"))
        made = gone.where(size == 2).select("graph_id", F.get("e", F.lit(0))["w"].alias("a"), F.get("e", F.lit(1))["w"].alias("b"), F.get("e", F.lit(0))["cw"].alias("ca"), F.get("e", F.lit(1))["cw"].alias("cb"), F.transform(_pairs(), lambda k: _lse(_scores(*_at(k)))).alias("t"))
        nodes = cut_lineage(nodes.join(chosen, KEYS, "left_anti").join(_summed(sent, KEYS, "m"), KEYS, "left").select(*KEYS, "card", _added(F.col("u"), F.col("m")).alias("u")))
        kept = edges
        for end in ("a", "b"):
            kept = kept.join(chosen.withColumnRenamed("var_id", end), ["graph_id", end], "left_anti")
        edges = cut_lineage(_merged(kept.unionByName(made)))
        if nodes.count() == left:
            raise ValueError("a variable of three neighbours or more is in each loop that is left")
    rest = _rest(nodes, edges)
    solved = cut_lineage(grouped.infer(rest, "treeinf"))
    constants.append(solved.groupBy("graph_id").agg(F.max("log_z").alias("z")))
    total = constants[0]
    for part in constants[1:]:
        total = total.unionByName(part)
    log_z = total.groupBy("graph_id").agg(F.sum("z").alias("log_z"))
    if not marginals:
        return log_z, None, None
    one, two = _solved(rest, solved)
    for gone in reversed(past):
        one, two = _back(gone, one, two)
    pairs = two.join(given, ["graph_id", "a", "b"])
    return log_z, one.select(*KEYS, F.posexplode("p").alias("s", "p")), pairs.select("graph_id", "a", "b", F.posexplode("p").alias("ei", "p"))


def _rest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is left as rows of packed(); factor 0 of a variable is its own table."""
    minus = lambda c: F.transform(c, lambda x: -x)
    own = nodes.select("graph_id", F.array("var_id").alias("vars"), F.array("card").alias("cards"), minus("u").alias("energies"))
    pair = edges.select("graph_id", F.array("a", "b").alias("vars"), F.array("ca", "cb").alias("cards"), minus("t").alias("energies"))
    return own.unionByName(pair).select("graph_id", F.pmod(F.xxhash64("vars"), F.lit((1 << 31) - 1)).cast("int").alias("hash"), "vars", "cards", "energies").withColumn("factor_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("hash", "vars")).cast("int")).drop("hash")


def _solved(rest: DataFrame, solved: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = solved.groupBy("graph_id", "factor_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ei", "p"))), lambda x: x["p"]).alias("p"))
    rows = rest.join(p, ["graph_id", "factor_id"])
    one = rows.where(F.size("vars") == 1).select("graph_id", F.get("vars", F.lit(0)).alias("var_id"), "p")
    return one, rows.where(F.size("vars") == 2).select("graph_id", F.get("vars", F.lit(0)).alias("a"), F.get("vars", F.lit(1)).alias("b"), "p")


def _back(gone: DataFrame, one: DataFrame, two: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distributions with those of the variables that one round took out, and of their pairs."""
    size = F.coalesce(F.size("e"), F.lit(0))
    n, first, second = F.col("card"), F.get("e", F.lit(0)), F.get("e", F.lit(1))
    share = lambda x: F.transform(F.array(_lse(x)), lambda z: F.transform(x, lambda y: F.exp(y - z)))[0]
    none = gone.where(size <= 0).select(*KEYS, share(F.col("u")).alias("p"))
    near = one.withColumnRenamed("var_id", "w").withColumnRenamed("p", "q")
    single = gone.where(size == 1).withColumn("w", first["w"]).join(near, ["graph_id", "w"])
    single = single.withColumn("j", F.flatten(F.transform(_states(first["cw"]), lambda i: F.transform(share(_scores(i)), lambda x: x * F.get("q", i)))))  # over (v, w)
    of_two = two.withColumnRenamed("p", "q")
    double = gone.where(size == 2).withColumns({"a": first["w"], "b": second["w"]}).join(of_two, ["graph_id", "a", "b"])
    double = double.withColumn("j", F.transform(_pairs(), lambda k: F.transform(share(_scores(*_at(k))), lambda x: x * F.get("q", k))))  # [pair][v]
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    cell = lambda k, s: F.get(F.get("j", k), s)
    over_v = F.transform(_states(n), lambda s: total(F.transform(_pairs(), lambda k: cell(k, s))))
    with_first = F.transform(_states(n * first["cw"]), lambda x: total(F.transform(_states(second["cw"]), lambda j: cell((F.floor(x / n) + j * first["cw"]).cast("int"), (x % n).cast("int")))))
    with_second = F.transform(_states(n * second["cw"]), lambda x: total(F.transform(_states(first["cw"]), lambda i: cell((i + F.floor(x / n) * first["cw"]).cast("int"), (x % n).cast("int")))))
    double = double.select(*KEYS, "card", "a", "b", "e", over_v.alias("p"), with_first.alias("j1"), with_second.alias("j2"))
    single = single.select(*KEYS, "card", "w", "e", F.transform(_states(n), lambda s: total(F.transform(_states(first["cw"]), lambda i: F.get("j", (s + i * n).cast("int"))))).alias("p"), "j")

    def edge(rows: DataFrame, w: str, card: Column, j: str) -> DataFrame:
        """Pairs with the smaller variable first."""
        v = F.col("var_id")
        return rows.select("graph_id", F.least(v, F.col(w)).alias("a"), F.greatest(v, F.col(w)).alias("b"), F.when(v < F.col(w), F.col(j)).otherwise(_turned(F.col(j), n, card)).alias("p"))

    ones = one.unionByName(none).unionByName(single.select(*KEYS, "p")).unionByName(double.select(*KEYS, "p"))
    twos = two.unionByName(edge(single, "w", first["cw"], "j")).unionByName(edge(double.withColumnRenamed("a", "wa").withColumnRenamed("b", "wb"), "wa", first["cw"], "j1")).unionByName(edge(double.withColumnRenamed("a", "wa").withColumnRenamed("b", "wb"), "wb", second["cw"], "j2"))
    return cut_lineage(ones), cut_lineage(twos)


def distances(links: DataFrame, roots: DataFrame, finish: int = FINISH, most_rounds: int = 200) -> DataFrame:
    """graph_id, var_id, d: the length of the shortest way from any root of the graph; what no root reaches is left out.

    links: graph_id, a, b, l (length); roots: graph_id, var_id. Vertices of at most two neighbours are taken out as in
    infer(), a way through one becomes a link of its own; when at most `finish` are left, or none can be taken out, a task
    per graph does the rest, and the others take their distance from their neighbours, round by round back.
    """
    edges = _shortest(links.where("a <> b").select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("l").cast("double").alias("l")))
    edges = cut_lineage(edges)
    ends = edges.select("graph_id", F.col("a").alias("var_id")).unionByName(edges.select("graph_id", F.col("b").alias("var_id")))
    nodes = cut_lineage(ends.distinct().join(roots.select(*KEYS).distinct(), KEYS, "left_anti"))
    past = []
    for step in range(most_rounds):
        if nodes.count() <= finish:
            break
        both = edges.select("graph_id", F.col("a").alias("v"), F.col("b").alias("w"), "l").unionByName(edges.select("graph_id", F.col("b").alias("v"), F.col("a").alias("w"), "l"))
        chosen = cut_lineage(_chosen(nodes, both, step))
        if not chosen.limit(1).count():
            break
        gone = cut_lineage(both.join(chosen.withColumnRenamed("var_id", "v"), ["graph_id", "v"]).groupBy("graph_id", F.col("v").alias("var_id")).agg(F.sort_array(F.collect_list(F.struct("w", "l"))).alias("e")))
        past.append(gone)
        first, second = F.get("e", F.lit(0)), F.get("e", F.lit(1))
        made = gone.where(F.size("e") == 2).select("graph_id", first["w"].alias("a"), second["w"].alias("b"), (first["l"] + second["l"]).alias("l"))
        kept = edges
        for end in ("a", "b"):
            kept = kept.join(chosen.withColumnRenamed("var_id", end), ["graph_id", end], "left_anti")
        edges = cut_lineage(_shortest(kept.unionByName(made)))
        nodes = cut_lineage(nodes.join(chosen, KEYS, "left_anti"))
    starts = roots.select("graph_id", F.col("var_id").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0.0).alias("l")).distinct()
    known = starts.unionByName(edges.select("graph_id", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "l")).groupBy("graph_id").applyInPandas(_nearest, "graph_id bigint, var_id bigint, d double")
    known = cut_lineage(known)
    for gone in reversed(past):
        way = gone.select(*KEYS, F.explode("e").alias("e")).select(*KEYS, F.col("e.w").alias("w"), F.col("e.l").alias("l"))
        own = way.join(known.select("graph_id", F.col("var_id").alias("w"), "d"), ["graph_id", "w"]).groupBy(*KEYS).agg(F.min(F.col("d") + F.col("l")).alias("d"))
        known = cut_lineage(known.unionByName(own.select("graph_id", F.col("var_id").cast("bigint").alias("var_id"), "d")))
    return known


def _shortest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id", "a", "b").agg(F.min("l").alias("l"))


def _nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """Shortest ways in one graph: rows without b are roots."""
    near: dict[int, list[tuple[int, float]]] = {}
    roots = rows[rows["b"].isna()]["a"].astype(int).tolist()
    for a, b, length in rows[rows["b"].notna()][["a", "b", "l"]].itertuples(index=False):
        near.setdefault(int(a), []).append((int(b), length))
        near.setdefault(int(b), []).append((int(a), length))
    found, line = {}, [(0.0, r) for r in roots]
    heapq.heapify(line)
    while line:
        d, v = heapq.heappop(line)
        if v not in found:
            found[v] = d
            for w, length in near.get(v, ()):
                if w not in found:
                    heapq.heappush(line, (d + length, w))
    return pd.DataFrame({"graph_id": rows["graph_id"].iloc[0], "var_id": list(found), "d": list(found.values())})
