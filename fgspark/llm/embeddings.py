"""Near copies among embeddings by an exact metric range join: pivots deal the vectors, the triangle inequality the borders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, written
from .components import components, forest

#: Vectors of a cell that are compared in one block; the fewest and the most pivots; the most frequent lengths of vectors
#: that get pivots (those of other lengths are one cell, which is compared block by block).
BLOCK = 2048
FEWEST_PIVOTS, MOST_PIVOTS = 4, 1024
LENGTHS = 64
#: Added to the radius of borders, far above rounding errors.
SLACK = 1e-6


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors of a sample, each the farthest from those before it; equal ones are not taken twice."""
    chosen = [0]
    near = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, 2 - 2 * sample @ sample[chosen[-1]])
        best = int(near.argmax())
        if near[best] < 1e-9:
            break
        chosen.append(best)
    return sample[chosen]


def homes(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each unit vector, matrix of the cells of smaller number that it visits).

    A vector lives with its nearest pivot. A vector that lives with pivot j and is at most radius from x lies beyond
    the plane half-way between j and x's home, so x visits the cells j whose plane is at most radius away. Of two homes
    the vector with the greater one visits the other, so a pair meets once.
    """
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = d2.argmin(axis=1)
    own = d2[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))[home]
    visits = (d2 - own[:, None] <= 2 * (radius + SLACK) * apart) & (np.arange(len(pivots)) < home[:, None])
    return home, visits


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of vectors.

    Two vectors are linked if their labels are equal and not null, they have equally many components and their cosine
    in double precision is at least `threshold` (above 0). Vectors that are null, empty, zero or hold null or non-finite
    components are not linked, nor are those with a null label: n_links 0, own component. Repeated rows are vectors of
    their own and linked. n_links counts linked rows; component_id is the smallest vec_id reached (null ids are passed
    over, so it is null where no row has one); kept says vec_id = component_id. An empty table gives no rows. Other
    columns are not read.

    Equal vectors are one point with a count. Pivots come from a sample of at most 4 * MOST_PIVOTS points; what they
    are decides only how even the cells are. Cells beyond BLOCK vectors are dealt in blocks and compared block by
    block. Cells return counts and spanning forests, never pairs.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(F.coalesce(finite & (F.size(v) > 0), F.lit(False)), v).alias("v"))
    valid = F.col("v").isNotNull() & F.col("label").isNotNull()
    points = rows.where(valid).groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    points = written(points.withColumn("node", F.monotonically_increasing_id()))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(r, dtype="<f8").tobytes() for r in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("node"), batch.column("copies"), pa.array(x, pa.binary())], names=["group", "node", "copies", "x"])

    # one group per label and number of components
    group = F.xxhash64(F.col("label").cast("string"), F.size("v"))
    coded = points.select(group.alias("group"), "node", "copies", "v").mapInArrow(raw, "group long, node long, copies long, x binary")
    n = points.count()
    wanted = min(MOST_PIVOTS, max(FEWEST_PIVOTS, -(-n // (4 * BLOCK))))
    size = F.size("v").alias("size")
    common = [r[0] for r in points.groupBy(size).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()]
    turn = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("node")))
    taken = points.select(size, "v", "node").where(F.col("size").isin(common)).withColumn("turn", turn).where(F.col("turn") <= 4 * wanted).select("size", "v").collect()
    sample: dict[int, np.ndarray] = {}
    for length in common:
        x = np.array([r.v for r in taken if r.size == length])
        sample[length] = pivots_of(x / np.sqrt((x * x).sum(axis=1))[:, None], wanted)
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    shared = points.sparkSession.sparkContext.broadcast(sample)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("x").to_pylist()
            lengths = np.array([len(r) // 8 for r in raws])
            take, cell, side = [], [], []
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                if size in shared.value:
                    home, visits = homes(_unit([raws[i] for i in at]), shared.value[size], radius)
                    i, j = np.nonzero(visits)
                else:
                    home, i, j = np.zeros(len(at), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                take += [at, at[i]]
                cell += [home, j]
                side += [np.zeros(len(at), dtype=np.int32), np.ones(len(i), dtype=np.int32)]
            where = pa.array(np.concatenate(take)) if take else pa.array([], pa.int64())
            out = batch.take(where)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell) if cell else [], pa.int64()), pa.array(np.concatenate(side) if side else [], pa.int32())], names=[*out.schema.names, "cell", "side"])

    dealt = coded.mapInArrow(deal, "group long, node long, copies long, x binary, cell long, side int")
    counted = dealt.groupBy("group", "cell").agg(F.sum((F.col("side") == 0).cast("long")).alias("here"), F.sum("side").alias("visitors"))
    full = dealt.join(counted.where("here > 0 and here + visitors > 1"), ["group", "cell"])
    k, kv = F.ceil(F.col("here") / BLOCK).cast("int"), F.ceil(F.col("visitors") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, k).otherwise(kv)).cast("int")
    # a resident meets the residents of every block, and every block of visitors; a visitor every block of residents
    meets = F.when(
        F.col("side") == 0,
        F.concat(
            F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.xxhash64(F.lit(0), "group", "cell", F.least(own, o), F.greatest(own, o)).alias("task"), (own > o).cast("int").alias("role"))),
            F.when(F.col("visitors") > 0, F.transform(F.sequence(F.lit(0), kv - 1), lambda o: F.struct(F.xxhash64(F.lit(1), "group", "cell", own, o).alias("task"), F.lit(0).alias("role")))).otherwise(F.expr("array()")),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.xxhash64(F.lit(1), "group", "cell", o, own).alias("task"), F.lit(1).alias("role"))))
    tasks = full.withColumn("m", F.explode(meets)).select("m.task", "m.role", "node", "copies", "x")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(tasks.repartition(parts, "task").sortWithinPartitions("task", "role").mapInArrow(_compare(threshold), "node long, other long, links long"))

    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("other is not null").select("node", "other"))
    classes = written(points.join(links, "node", "left").join(reached, "node", "left").select("label", "v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")), instead_of=(found, reached, points))
    least = written(classes.groupBy("root").agg(F.min("first").alias("component_id")))  # so that the join can split a large component
    named = classes.join(least, "root").select("label", "v", "n_links", "component_id")
    linked = rows.where(valid).join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])

        def out() -> pa.RecordBatch | None:
            a, b = sides
            if len(a) + len(b) < 2 or not a:
                return None
            xa = _unit([r[2] for r in a])
            xb = _unit([r[2] for r in b]) if b else xa
            ids_a, ids_b = np.array([r[0] for r in a]), np.array([r[0] for r in b or a])
            weight_a, weight_b = np.array([r[1] for r in a]), np.array([r[1] for r in b or a])
            count_a, count_b, stars = np.zeros(len(a), np.int64), np.zeros(len(ids_b), np.int64), []
            for at in range(0, len(a), 512):
                near = xa[at : at + 512] @ xb.T >= threshold
                if not b:
                    near[np.arange(len(near)), at + np.arange(len(near))] = False
                count_a[at : at + 512] = near @ weight_b
                if b:
                    count_b += weight_a[at : at + 512] @ near
                i, j = np.nonzero(near)
                stars += forest(ids_a[i + at].tolist(), ids_b[j].tolist())
            rows = [(int(n), None, int(c)) for ids, counts in ((ids_a, count_a), (ids_b, count_b)) for n, c in zip(ids, counts) if c]
            rows += [(x, y, 0) for x, y in stars]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["node", "other", "links"])

        for batch in batches:
            for t, role, node, copies, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if t != task:
                    if (done := out()) is not None:
                        yield done
                    task, sides = t, ([], [])
                sides[role].append((node, copies, x))
        if (done := out()) is not None:
            yield done
        settle()

    return run
