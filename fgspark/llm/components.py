"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_sort, forget, settle, written

#: Links that one union-find holds at a time.
FOREST_LINKS = 500_000


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(node, smallest node it reaches) for every node of the links that is not itself the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for x, y in zip(a, b):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            parent.setdefault(min(x, y), min(x, y))
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def out() -> pa.RecordBatch:
        stars = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([y for _, y in stars], pa.int64())], names=["u", "v"])

    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) >= FOREST_LINKS:
            yield out()
            a, b = [], []
    if a:
        yield out()
    settle()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: two columns of long ids, in either order, with repeats, loops and nulls (ignored).

    Returns (node, component): every node that reaches a smaller one, and the smallest node it reaches. Each task
    first replaces its links by stars of the same reach. Then stars alternate (large: a node's greater neighbours move
    to its smallest one; small: its smaller neighbours do) until nothing changes, a logarithmic number of rounds. A
    round is joins and sums by key over links alone and ends in a table, which takes the place of the last one; a hub
    with many links is summed before the shuffle, the joins' skewed partitions can be split, and no side is
    broadcast. forget() takes what is returned.
    """
    a, b = links.columns
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(pairs.mapInArrow(_forests, "u long, v long").distinct())
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(by_sort(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_sort(down), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(down.withColumnRenamed("m", "v")).distinct(), instead_of=(edges,))
    else:
        forget(edges)
        raise RuntimeError(f"links still change after {most_rounds} rounds")
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    found.written_to = edges.written_to
    return found
