"""Near copies by word shingles: an exact prefix-filter join finds candidates, exact similarities decide.

Put the distinct five-word shingles of every text in one order that all texts share. Two sets with a similarity
(Jaccard) of `percent` / 100 or more overlap in at least that part of each, so of the first n - ceil(n * percent / 100)
+ 1 shingles of either one is in both: a pair without such a common shingle needs no look. Shingles that a sample of the
texts shows to be frequent come last in the order, which spares work and cannot change results.

Pairs under a common shingle are let through by two bounds that no similar pair breaks: that of the sizes, and that of
the sets' difference (each shingle in one set only flips one parity bit, so parities differ in at most as many bits).
What is left is grouped, each group's shingle sets are brought together once, and their exact similarities link.

With a radius, SimHash fingerprints link too, as simhash.near_copies() links them; groups are those of both kinds of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, in_blocks, pieces, settle, utf8, written
from .components import components, forest
from .simhash import BLOCK, fingerprint, near_links

WORDS, PERCENT = 5, 80
#: Words of the shingles of a fingerprint.
MARKED = 4
#: One in SAMPLE of the texts is looked at for frequent shingles; so often a frequent one is there; so many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 128, 4, 50_000
#: Sets, and shingles of all sets (8 bytes each), that are compared exactly at a time.
EXACT_BLOCK, HEAVY = 512, 1 << 20


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of the set of shingles (of the whole text if it has fewer words, of nothing without any)."""
    tokens = text.lower().split()
    line = b" ".join(tokens)
    starts = list(accumulate((len(t) + 1 for t in tokens), initial=0))
    found = {line[s : e - 1] for s, e in zip(starts, starts[words:] or starts[-1:])} if tokens else {b""}
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in found], dtype="<u8"))


def prefix(hashes: np.ndarray, frequent: np.ndarray, weights: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles one of which a set shares with every similar one. frequent: sorted hashes, weights: how frequent."""
    n = len(hashes)
    first = n - -(-n * percent // 100) + 1
    if not len(frequent):
        return hashes[:first]
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    return hashes[np.lexsort((hashes, np.where(frequent[at] == hashes, weights[at], 0)))[:first]]


def parities(hashes: np.ndarray) -> bytes:
    """Twice as many bits as there are shingles or more, a power of two: bit i is the parity of those equal to i modulo it."""
    size = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def _tiers(n: np.ndarray, bits: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, sizes, parities) of the sets that have equally many parities."""
    lengths = np.array([len(b) for b in bits], np.int64)
    at = [np.nonzero(lengths == k)[0] for k in np.unique(lengths)]
    return [(p, n[p], np.frombuffer(b"".join(bits[i] for i in p), "<u8").reshape(len(p), -1)) for p in at]


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _possible(sets: list[tuple], others: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets (tiers) against the others that the two bounds let through."""
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p, n, x in sets:
        for q, m, y in others:
            if not len(m) or 100 * n.max() < percent * m.min() or 100 * m.max() < percent * n.min():
                continue
            words = min(x.shape[1], y.shape[1])
            u, v = _folded(x, words), _folded(y, words)
            step = max(1, (1 << 18) // (len(m) * words))
            for k in range(0, len(n), step):
                a = n[k : k + step, None]
                i, j = np.nonzero(100 * np.minimum(a, m) >= percent * np.maximum(a, m))
                apart = np.bitwise_count(u[i + k] ^ v[j]).sum(axis=1, dtype=np.int64)
                good = (100 + percent) * apart <= (100 - percent) * (n[i + k] + m[j])
                found_i.append(p[i[good] + k])
                found_j.append(q[j[good]])
    return np.concatenate(found_i), np.concatenate(found_j)


def _loose(a: list[tuple], b: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Rows (node, n, parities): a spanning forest of the pairs that the bounds let through."""
    y = b or a
    others, stars = _tiers(np.array([r[1] for r in y], np.int64), [r[2] for r in y]), []
    for at in range(0, len(a), 256):
        x = a[at : at + 256]
        i, j = _possible(_tiers(np.array([r[1] for r in x], np.int64), [r[2] for r in x]), others, percent)
        stars += forest([x[k][0] for k in i.tolist()], [y[k][0] for k in j.tolist()])
    return stars


def _exact(a: list[tuple], b: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Rows (node, hashes): links that reach what all pairs of a similarity of percent / 100 or more do."""
    rows = a + b
    sets = [np.frombuffer(r[1], "<u8") for r in rows]
    n = np.array([len(s) for s in sets], np.int64)
    bits = [parities(s) for s in sets]
    tiers, label, links = _tiers(n, bits), np.arange(len(rows)), []
    for i in range(len(a)):
        apart = label != label[i]
        apart[: len(a) if b else i + 1] = False
        if not apart.any():
            continue
        others = [(p[w], m[w], y[w]) for p, m, y in tiers if (w := apart[p]).any()]
        for j in _possible(_tiers(n[i : i + 1], bits[i : i + 1]), others, percent)[1].tolist():
            if label[i] != label[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (n[i] + n[j] - common):
                    links.append((rows[i][0], rows[j][0]))
                    label[label == label[j]] = label[i]
    return links


def _cells(linked, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bucket, x, y, side): a cell is a group or two blocks of a large one; linked() gives its links."""
        cell, sides = None, ([], [])

        def out() -> list[tuple[int, int]]:
            a, b = sides
            return linked(a, b, percent) if a and len(a) + len(b) > 1 else []

        def batch_of(stars: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], names=["a", "b"])

        found: list[tuple[int, int]] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for bucket, x, y, side, *row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
                    if (bucket, x, y) != cell:
                        found += out()
                        cell, sides = (bucket, x, y), ([], [])
                    sides[side].append(tuple(row))
            if len(found) > 100_000:
                yield batch_of(found)
                found = []
        yield batch_of(found + out())
        settle()

    return run


def _linked(cells: DataFrame, rule, percent: int) -> DataFrame:
    """(node, component) by what rule() links in each cell."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side")
    return components(dealt.mapInArrow(_cells(rule, percent), "a long, b long").distinct())


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that are frequent in a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in pieces(batch, "t"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, words) for t in values]).view("<i8"))], names=["h"])

    some = texts.select("t").where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long")
    rows = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n")).limit(MOST_FREQUENT).collect()
    hashes, counts = np.array([r.h for r in rows], "<i8").view("<u8"), np.array([r.n for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _with_marks(points: DataFrame, reached: DataFrame, radius: int) -> DataFrame:
    """points: node, fp. (node, component) by the links of reached, which is deleted, and of near fingerprints."""
    near = components(near_links(points.select("fp").distinct(), radius))
    classes = points.select("node", "fp").join(near.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("component", "fp").alias("root"))
    least = written(classes.groupBy("root").agg(F.min("node").alias("first")))  # so that the join can split a large component
    stars = classes.join(least, "root").select(F.col("node").alias("a"), F.col("first").alias("b"))
    both = components(stars.unionByName(reached.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    forget(near, least, reached)
    return both


def firsts(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, radius: int | None = None) -> DataFrame:
    """texts: key binary (equal for equal texts only), id long, t binary. Returns (key, id) of the first row of each group
    of near copies: its smallest id, of rows of equal id the smallest key. forget() takes what is returned.
    radius: fingerprints at most so many bits apart link too (None: they do not).

    Texts are read for the shingles of their prefixes, which a row per key keeps (combined before the shuffle where
    copies abound), and again, a row of each key, where there is a possible partner.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words))

    def points_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, weights = shared.value
        for batch in batches:
            for first, values in pieces(batch, "t"):
                sets = [shingles(t, words) for t in values]
                keys = pa.array([prefix(s, frequent, weights, percent).view("<i8") for s in sets], pa.list_(pa.int64()))
                own = [batch.column(c).slice(first, len(values)) for c in ("key", "id")]
                marks = np.array([0 if radius is None else fingerprint(t, MARKED) for t in values], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(marks), pa.array([parities(s) for s in sets], pa.binary()), keys], names=["key", "id", "n", "fp", "bits", "keys"])
        settle()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values in pieces(batch, "t"):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(values)), pa.array([shingles(t, words).tobytes() for t in values], pa.binary())], names=["key", "hashes"])
        settle()

    found = texts.select("key", "id", "t").mapInArrow(points_of, "key binary, id long, n long, fp long, bits binary, keys array<long>")
    points = found.groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "keys")])
    points = written(points.withColumn("node", F.monotonically_increasing_id()))
    cells = in_blocks(points.select(F.explode("keys").alias("bucket"), "node"), BLOCK)
    loose = _linked(cells.join(points.select("node", "n", "bits"), "node").select("bucket", "x", "y", "side", "node", "n", "bits"), _loose, percent)
    groups = loose.unionByName(loose.select(F.col("component").alias("node"), "component").distinct())
    groups = written(groups.join(points.select("node", "key", "id", "n"), "node").withColumnRenamed("component", "bucket"), instead_of=(loose,))
    # texts are streamed past the small side's hash table, not sorted
    sets = texts.select("key", "id", "t").join(groups.select("key", "id").hint("shuffle_hash"), ["key", "id"], "left_semi").select("key", "t").mapInArrow(sets_of, "key binary, hashes binary")
    sets = written(sets.groupBy("key").agg(F.first("hashes").alias("hashes")).join(groups.select("key", "node"), "key").select("node", "hashes"))
    cells = in_blocks(groups.select("bucket", "node", "n"), min(BLOCK, EXACT_BLOCK), "n", HEAVY)
    reached = _linked(cells.join(sets, "node").select("bucket", "x", "y", "side", "node", "hashes"), _exact, percent)
    if radius is not None:
        reached = _with_marks(points, reached, radius)
    named = points.select("node", "key", "id").join(reached, "node", "left").select("key", "id", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct("id", "key")).alias("least"))
    return written(least.select("least.key", "least.id"), instead_of=(points, groups, sets, reached))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest id; all columns stay.

    radius: SimHash fingerprints at most so many bits apart make near copies too.

    Null text counts as empty; empty texts are one group. Null ids come after all others, by a hash of the text. Rows
    equal in id and text count once. An empty table stays empty. Equality of texts is that of 128 bits of their SHA-256.
    The rows that stay are found from ids and hashes; then the texts are dealt once, past a hash table of those.
    """
    data = utf8(text_col)
    row_id = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit(1), data), F.lit(1 << 61)))
    keyed = docs.withColumns({"__key": F.substring(F.unhex(F.sha2(data, 256)), 1, 16), "__id": row_id})
    kept = firsts(keyed.select(F.col("__key").alias("key"), F.col("__id").alias("id"), data.alias("t")), radius=radius).select(F.col("key").alias("__key"), F.col("id").alias("__id"))
    chosen = keyed.join(kept.hint("shuffle_hash"), ["__key", "__id"], "left_semi")
    repeated = written(keyed.groupBy("__key", "__id").agg(F.count("*").alias("n")).where("n > 1").select("__key", "__id"))
    if not repeated.limit(1).count():
        forget(repeated)
        return chosen.select(*docs.columns)
    once = chosen.join(repeated.hint("shuffle_hash"), ["__key", "__id"], "left_anti")
    again = chosen.join(repeated.hint("shuffle_hash"), ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"])
    return once.unionByName(again).select(*docs.columns)
