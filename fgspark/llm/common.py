"""What the operators of this subpackage share: intermediate tables, blocks of large groups, batches of bytes, a scan of 2-state chains."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings while a table is written: shuffle files go at the end of the query that made them, not at some later
#: collection; batches for Python are smaller than by default (64 MB), as an executor holds several of each.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir of the session. Where that is unset, a temporary folder if driver
    and executors are one process (tests), else an error: executors of a cluster share no local folder."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not folder and not context.isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fgspark-checkpoint-"))
    return context.getCheckpointDir().get()


@contextlib.contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; what they write must be all that is needed of them."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, *, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The rows of df as a compressed table in the shared checkpoint folder, so that a lost executor costs no earlier stage.

    instead_of: tables that written() gave and that nothing but df needed; their files are deleted.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    with writing(spark):
        df.write.option("compression", "zstd").parquet(folder)
    forget(*instead_of)
    found = spark.read.schema(df.schema).parquet(folder)
    found.written_to = folder
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_sort(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles and sorts both sides, whatever their size.

    Spark takes a table for as large as its compressed files, and exploded rows for as large as those before; by that it
    broadcasts, through the driver, what is many times as large as it may be (millions of copies, 31 rows of a point).
    """
    return df.hint("merge")


def in_blocks(grouped: DataFrame, block: int, weight: str | None = None, heavy: int = 1) -> DataFrame:
    """grouped: bucket, node (and weight), each pair once. (bucket, x, y, side, node): cells in which all pairs of a bucket meet.

    A bucket of up to `block` nodes (whose weights add up to `heavy` at most) is one cell, all of side 0. A larger one is
    dealt into blocks of about half of that, and each two blocks are a cell, their nodes on sides 0 and 1; a block meets
    itself in a cell without a side 1. Buckets of one node are left out.
    """
    sums = [F.count("*").alias("n"), *([F.sum(weight).alias("heavy")] if weight else [])]
    sizes = grouped.groupBy("bucket").agg(*sums).where("n > 1")
    full = grouped.select("bucket", "node").join(by_sort(sizes), "bucket")
    fits, blocks = F.col("n") <= block, F.ceil(F.col("n") / (block // 2))
    if weight:
        fits, blocks = fits & (F.col("heavy") <= heavy), F.greatest(blocks, F.ceil(F.col("heavy") / F.lit(max(1, heavy // 2))))
    zero = F.lit(0)
    small = full.where(fits).select("bucket", zero.alias("x"), zero.alias("y"), zero.alias("side"), "node")
    large = full.where(~fits).withColumn("k", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(zero, F.col("k") - 1)))
    return small.unionByName(large.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """Text as its UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def runs(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of rows of about `most` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64) + 1)
    first, before = 0, 0
    while first < len(values):
        last = min(int(np.searchsorted(ends, before + most)), len(values) - 1)
        yield first, last + 1
        first, before = last + 1, int(ends[last])


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The binary column in runs of rows of about `most` bytes (one row at least): (first row, values)."""
    values = batch.column(column)
    for first, end in runs(values, most):
        yield first, values.slice(first, end - first).to_pylist()


def settle() -> None:
    """Gives what a Python worker has freed back to the system; workers are kept between tasks and add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def moebius_scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, width: int = 128) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) with r[-1] = 0, for non-negative coefficients.

    The ratio of the two messages of a 2-state chain moves by such maps. They compose as 2x2 matrices, so the chain is
    cut in rows of `width` steps: each row's product is taken for all rows at once, the products are followed row by
    row, and the rows are filled in, again at once. Rows in which a and c are 0 start a new chain.
    """
    n = len(a)
    if not n:
        return np.zeros(0)
    rows = -(-n // width)
    grid = []
    for x, idle in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        full = np.full(rows * width, idle)
        full[:n] = x
        grid.append(np.ascontiguousarray(full.reshape(rows, width).T))
    a, b, c, d = grid
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    enter, x = np.zeros(rows), 0.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        enter[i] = x
        x = (pi * x + qi) / (ri * x + si)
    out = np.empty((width, rows))
    x = enter
    for t in range(width):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]
