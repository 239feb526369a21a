"""Importance resampling: documents are drawn by the ratio of hashed n-gram models of target and raw text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
#: Labelled documents of good quality that the target model is made from, at most (the first by a hash of the id).
MAX_TARGET = 20_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Words that the hash cache holds before it starts anew.
CACHED = 400_000


def grams(text: str, cache: dict[str, int], buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and word pairs, repeats included."""
    words = TOKEN.findall(text)
    if len(cache) > CACHED:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)
    return (np.concatenate([h * np.uint64(0xC2B2AE3D), pairs ^ np.uint64(0x5BD1E995)]) >> np.uint64(7)) % np.uint64(buckets)


def _batches(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def counts(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cache = np.zeros(buckets, dtype=np.int64), {}
        for batch in batches:
            for text in _batches(batch.column(0)):
                total += np.bincount(grams(text, cache, buckets).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # at most a row per bucket
    out = np.zeros(buckets)
    for r in rows:
        out[r.b] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, both with one added to every count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def kth_largest(df: DataFrame, column: str, k: int, most: int = 50_000) -> float | None:
    """The k-th largest value (not null), by counts of ever narrower bins; at most `most` values come to the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    rest, part = k, df.where(F.col(column).isNotNull())
    while True:
        inside = part.where((F.col(column) >= low) & (F.col(column) <= high))
        if low == high or (high - low) <= abs(high) * 1e-15:
            return low
        step = (high - low) / 1024
        bin_ = F.least(F.lit(1023), F.floor((F.col(column) - low) / step))
        rows = sorted(inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.b)
        for r in rows:
            if rest <= r.n:
                low, high, n = r.lo, r.hi, r.n
                break
            rest -= r.n
        else:
            return rows[-1].lo
        if n <= most:
            values = sorted((r[0] for r in part.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)
            return values[rest - 1]


def resample(docs: DataFrame, target: DataFrame, share: float = 0.8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept: a row per row of docs.

    The target model counts the hashed words and word pairs of `target` (column text, bounded by its caller), the raw
    model those of all docs. log_weight is the sum over a document's n-grams of the models' log ratio; key adds Gumbel
    noise from a hash of the id and seed, and the floor(share * rows) largest keys are kept, which draws documents
    without replacement in proportion to their weights. Of equal keys the smaller ids are kept, a null id last; rows
    equal in key and id are kept or left together. Null or empty text: log_weight 0. Null ids have noise by their text. Repeated rows stay. An empty table
    gives no rows. Other columns are not read.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(counts(target, text_col), counts(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        weights = ratio.value
        for batch in batches:
            found = [grams(t, cache) for t in _batches(batch.column("t"))]
            own = [batch.column(c) for c in ("doc_id", "noise")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(g) for g in found], pa.int64()), pa.array([float(weights[g].sum()) for g in found], pa.float64())], names=["doc_id", "noise", "n_grams", "log_weight"])

    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    noise = F.xxhash64(F.lit(seed), own, F.when(own.isNull(), F.coalesce(text, F.lit(""))))
    scored = docs.select(own.alias("doc_id"), noise.alias("noise"), text.alias("t")).mapInArrow(run, "doc_id long, noise long, n_grams long, log_weight double")
    uniform = (F.pmod("noise", F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = written(scored.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")))
    k = int(share * keyed.count())
    limit = kth_largest(keyed, "key", k)
    if limit is None:
        return keyed.withColumn("kept", F.lit(False))
    above = keyed.where(F.col("key") > limit).count()
    # ids of one key are few: they differ in noise unless hashes agree
    order = F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")
    ties = keyed.where(F.col("key") == limit).groupBy(F.struct(*order).alias("tie")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("tie").rowsBetween(Window.unboundedPreceding, -1))
    last = ties.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k - above).agg(F.max("tie")).first()[0]
    return keyed.withColumn("kept", (F.col("key") > limit) | (F.col("key") == limit) & (F.struct(*order) <= F.struct(F.lit(last[0]).alias("none"), F.lit(last[1]).cast("long").alias("id"))))


def target_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TARGET) -> DataFrame:
    """At most `most` documents labelled as good (quality 1), the first by a hash of the id; their ids are broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").groupBy("doc_id").agg(F.lit(1)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(good), "doc_id", "left_semi")
