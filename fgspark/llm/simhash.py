"""SimHash fingerprints, and near copies among them by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_sort, forget, in_blocks, pieces, utf8, written
from .components import components, forest

HASH_SEED = 42
#: Fingerprints of a bucket that are compared in one block.
BLOCK = 2048


def fingerprint(text: bytes, words: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words.

    A-Z become lower case, words are runs of bytes other than ASCII white space, a shingle is `words` of them joined by
    a space (the whole sequence if there are fewer), its hash XXH64. A bit is 1 if over half of the hashes have it.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    starts = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    ends = starts[words:] or starts[-1:]
    hashes = np.array([xxhash.xxh64_intdigest(line[s : e - 1], HASH_SEED) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp the signed 64 bits. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "t"):
                found = np.array([fingerprint(t, words) for t in texts], dtype="<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 bit masks such that any two words at most `radius` bits apart agree on one of them.

    Each bit position i gets a vector m(i) of radius+1 bits, and the mask of a non-zero vector v has the bits i with
    odd m(i).v. Up to `radius` differing positions give as many equations m(i).v = 0 in radius+1 unknowns, which some
    non-zero v solves: the mask of that v has none of those positions. Vectors are dealt evenly, so masks are alike.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def links_within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the words of a and b at most radius bits apart."""
    found_i, found_j = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None, :]) <= radius)
        found_i.append(i + k)
        found_j.append(j)
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def _block_forests(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by (bucket, x, y, side): a cell is a bucket or two blocks of a large one. A cell gives a forest."""
        cell, sides = None, ([], [])

        def out() -> list[tuple[int, int]]:
            x, y = (np.array(s, dtype="<i8") for s in sides)
            both = np.concatenate([x, y])
            if len(both) < 2:
                return []
            i, j = links_within(both.view("<u8"), both.view("<u8"), radius) if not len(y) else links_within(x.view("<u8"), y.view("<u8"), radius)
            other = both if not len(y) else y
            keep = both[i] != other[j]
            return forest(both[i][keep].tolist(), other[j][keep].tolist())

        def batch_of(stars: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.int64()), pa.array([s[1] for s in stars], pa.int64())], names=["a", "b"])

        stars: list[tuple[int, int]] = []
        for batch in batches:
            for *c, side, fp in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if c != cell:
                    stars += out()
                    cell, sides = c, ([], [])
                sides[side].append(fp)
            if len(stars) > 100_000:
                yield batch_of(stars)
                stars = []
        yield batch_of(stars + out())

    return run


def near_links(points: DataFrame, radius: int) -> DataFrame:
    """points: distinct non-null fp. Links (a, b) with the same components as all pairs within radius.

    Each fp is sent to one bucket per mask. Buckets with one fp go at once (a sum by key, combined before the shuffle).
    A bucket of up to BLOCK fps is one cell. A larger one is dealt into n blocks of about half of that, and each two blocks are a
    cell of their own, so no task holds a large bucket and no pair is left out. A cell returns a spanning forest of its
    links, never the pairs.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)])
    cells = in_blocks(points.select(F.col("fp").alias("node"), F.explode(keys).alias("bucket")), BLOCK).select("bucket", "x", "y", "side", "node")
    n = cells.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return cells.repartition(int(n), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side").mapInArrow(_block_forests(radius), "a long, b long").distinct()


def near_copies(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of docs.

    component_id is the smallest doc_id reachable by links between fingerprints at most `radius` bits apart. Equal
    fingerprints are one point, so a group of copies costs one. Null text: as empty. Null doc_id: gets a component_id
    by its fingerprint like others but gives none (null if no other id is there). Repeated rows stay. An empty table
    gives none. Other columns are not read. No table goes through the driver.
    """
    marked = written(fingerprints(docs, words, id_col, text_col))
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = components(near_links(points.select("fp"), radius))
    classes = written(points.join(by_sort(reached), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), instead_of=(reached,))
    least = written(classes.groupBy("root").agg(F.min("first").alias("component_id")))  # so that the join can split a large component
    named = classes.join(by_sort(least), "root").select("fp", "component_id")
    return marked.join(by_sort(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
