"""Removal of long repeated byte strings by suffix order and longest previous factors, across all documents.

Strings of `length` bytes ("windows") that are equal have the same minimizer (the 16 bytes in them with the least hash,
the first of equals), at the same place. Neighbouring windows with one minimizer are a region. Regions are dealt by
their minimizer's hash, so equal windows meet. Then, in growing order of cost:

1. A minimizer that occurs once has no repeated window: a count by key.
2. Regions of the same minimizer and content are repeated as a whole: another count, copies cost one row.
3. What differs under one minimizer is put in suffix order, many minimizers at a time. The previous and the next smaller
   position on this order give the two longest earlier matches of a window, and the greater of their common prefixes is
   its longest previous factor; where that is all of the window, it is a later copy, and the match a copy that has one.
4. A minimizer with very many different regions isn't gathered. Its windows are parted by their distance from the
   minimizer, in classes of ever fewer windows; windows of a class share bytes around the minimizer, so parts are dealt
   by those, and steps 1 to 3 hold for them. A row becomes a few parts at each of the levels, the last of one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces, settle, utf8, written

LENGTH = 200
GRAM = 16
#: Different regions of one minimizer from which they are parted instead of gathered, and the widths of parts.
MANY = 2048
WIDTHS = (48, 12, 3, 1)
#: Bytes that are put in suffix order at once.
ORDERED = 1 << 19
#: Bytes of a text that are cut into regions at once; windows across the border belong to the part before it.
PART = 1 << 26
#: Rounds in which all positions look for a smaller one together; the few that need more go one by one.
ROUNDS = 48
_POSITION = np.uint64((1 << 28) - 1)


def nearest_smaller(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place r of the suffix order: the nearest place before it with a smaller position (-1: none), and the common
    prefix with that one, the least of common[] on the way. A way on which nothing is common any more ends as none.

    Places whose candidate is greater take over that one's candidate: what lies between is greater still.
    """
    near, least = np.arange(-1, len(order) - 1), common.copy()
    active = np.arange(len(order))
    for _ in range(ROUNDS):
        at = near[active]
        more = (at >= 0) & (least[active] > 0)
        more[more] = order[at[more]] > order[active[more]]
        active = active[more]
        if not len(active):
            break
        at = at[more]
        further, low = near[at], np.minimum(least[active], least[at])
        near[active], least[active] = further, low
    for r in active.tolist():  # from left to right, so that each finds those before it done
        while near[r] >= 0 and least[r] > 0 and order[near[r]] > order[r]:
            least[r], near[r] = min(least[r], least[near[r]]), near[near[r]]
    none = (near < 0) | (least == 0)
    near[none], least[none] = -1, 0
    return near, least


def longest_previous(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order: positions 0 .. n - 1 in suffix order; common[r]: the common prefix of order[r - 1] and order[r], common[0] 0.

    Returns by position the longest previous factor (the length of the longest string that starts there and also at a
    smaller position) and the smaller position (-1 where the length is 0).
    """
    n = len(order)
    before, left = nearest_smaller(order, common)
    after, right = nearest_smaller(order[::-1], np.append(common[1:], 0)[::-1] if n else common)
    after, right = np.where(after < 0, -1, n - 1 - after)[::-1], right[::-1]
    source = np.where(left >= right, before, after)
    length, place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    length[order] = np.maximum(left, right)
    place[order] = np.where(source < 0, -1, order[source])
    return length, place


def grams(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes at each position."""
    n = len(buffer) - GRAM + 1
    raw = np.ascontiguousarray(buffer)
    a = np.ndarray((n,), dtype="<u8", buffer=raw, strides=(1,)).copy()
    b = np.ndarray((n,), dtype="<u8", buffer=raw, offset=8, strides=(1,)).copy()
    a *= np.uint64(0x9E3779B97F4A7C15)
    b *= np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(29)
    b ^= b >> np.uint64(32)
    a += b
    a *= np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xD6E8FEB86659FD93)
    a ^= a >> np.uint64(31)
    return a


def regions(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, minimizer, its hash, content hash) of all regions of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(texts)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    if not (sizes >= length).any():
        return none
    if len(joined) > _POSITION:
        raise ValueError("more than 268 million bytes at once")
    hashes = grams(np.frombuffer(joined, dtype=np.uint8))
    width, n = length - GRAM + 1, len(hashes)
    keyed = (hashes & ~_POSITION) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64((1 << 64) - 1))
    grid[:n] = keyed
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - width + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _POSITION).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    begin = np.zeros(len(joined) + 1, dtype=np.int32)  # windows that lie in one text
    long = sizes >= length
    np.add.at(begin, starts[long], 1)
    np.add.at(begin, ends[long] - length + 1, -1)
    valid = np.cumsum(begin[:windows]) > 0
    change = np.ones(windows, dtype=bool)
    change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    change[np.minimum(starts[long], windows - 1)] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    first, last = first[valid[first]], last[valid[first]]
    text = np.searchsorted(ends, first, side="right")
    content = np.array([xxhash.xxh3_64_intdigest(joined[a : b + length]) for a, b in zip(first.tolist(), last.tolist())], dtype=np.uint64)
    return text, first - starts[text], last - starts[text], place[first] - starts[text], hashes[place[first]].view(np.int64), content.view(np.int64)


def parts(data: bytes, a: int, anchor: int, m: int, length: int, width: int) -> list[tuple[int, int, int, int]]:
    """A region's windows by their distance from the minimizer, `width` distances a class.

    data: the region's bytes, from a on. Gives (first window, last window, hash of m, class and the bytes that all
    windows of the class have, content hash) for each class.
    """
    b, out = a + len(data) - length, []
    for k in range((anchor - b) // width, (anchor - a) // width + 1):
        first, last = max(a, anchor - (k + 1) * width + 1), min(b, anchor - k * width)
        shared = data[anchor - k * width - a : anchor - (k + 1) * width + 1 + length - a]
        key = xxhash.xxh3_64_intdigest(b"%d %d " % (m, k) + shared)
        content = xxhash.xxh3_64_intdigest(data[first - a : last + length - a])
        out.append((first, last, *(x - (1 << 64) if x >> 63 else x for x in (key, content))))
    return out


def ranks(buffer: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of each position with h bytes from it on among all strings of h bytes) for h = 8, 16, 32, .. and `length`.

    Prefix doubling: the rank of 2h bytes is that of the ranks of the first and the second h bytes.
    """
    n, h = len(buffer), 8
    words = np.ndarray((n - 7,), dtype=">u8", buffer=np.ascontiguousarray(buffer), strides=(1,)).astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1]
    found = [(h, rank.astype(np.int32))]
    while h < length:
        step = min(h, length - h)
        m = n - h - step + 1
        rank = np.unique(rank[:m] * np.int64(n + 1) + rank[step : step + m], return_inverse=True)[1]
        h += step
        found.append((h, rank.astype(np.int32)))
    return found


def suffix_order(buffer: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings of `length` bytes at `where` (rising) in order, of equal ones the earlier first, and
    how many bytes each has in common with the one before it."""
    levels = ranks(buffer, length)
    own = levels[-1][1][where].astype(np.int64)
    order = np.argsort(own * np.int64(len(where)) + np.arange(len(where)))
    a, b = where[order[:-1]], where[order[1:]]
    same = own[order[:-1]] == own[order[1:]]
    common = np.zeros(len(where), dtype=np.int64)
    common[1:][same] = length
    i = np.flatnonzero(~same)
    a, b, k = a[i], b[i], np.zeros(len(i), dtype=np.int64)
    for h, rank in reversed(levels[:-1] if len(levels) > 1 else []):
        fits = k + h <= length
        x, y = np.minimum(a + k, len(rank) - 1), np.minimum(b + k, len(rank) - 1)
        k += h * (fits & (rank[x] == rank[y]))
    padded = np.concatenate([buffer, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    differ = words[a + k] ^ words[b + k]
    lowest = differ & (~differ + np.uint64(1))  # the first byte that differs holds the lowest bit
    common[1:][i] = np.minimum(k + (np.bitwise_count(lowest - np.uint64(1)) >> 3), length - 1)
    return order, common


def repeated_starts(texts: list[bytes], order: list[tuple], length: int, first_stays: bool) -> list[np.ndarray]:
    """For each text the flags of its windows that occur at another position of the texts (or only at an earlier one).

    order gives the texts' places in the corpus; positions compare by it, then by the offset.
    """
    turn = sorted(range(len(texts)), key=lambda i: order[i])
    joined = np.frombuffer(b"".join(texts[i] for i in turn), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in turn])
    ends = np.cumsum(sizes)
    where = np.concatenate([np.arange(e - n, e - length + 1) for e, n in zip(ends, sizes)])
    factor, earlier = longest_previous(*suffix_order(joined, where, length))
    flags = factor >= length
    if not first_stays:
        flags[earlier[flags]] = True
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(texts)
    at = 0
    for i, n in zip(turn, (sizes - length + 1).tolist()):
        out[i] = flags[at : at + n]
        at += n
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _to_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they hold only a part of."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(row, offset, texts) of the column t; a very long text comes in parts that overlap by less than a window."""
    for at, texts in pieces(batch, "t"):
        if len(texts) > 1 or len(texts[0]) <= PART:
            yield at, 0, texts
            continue
        for shift in range(0, len(texts[0]) - length + 1, PART):
            yield at, shift, [texts[0][shift : shift + PART + length - 1]]


def spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", many: int = MANY) -> DataFrame:
    """docs: doc_id long, key binary (a hash of the text), t binary. Returns (key, spans): the repeated byte ranges of each text.

    keep: "none" gives all bytes of repeated windows, "first" those of windows that an earlier position has (by doc_id,
    then offset; for a text that several documents share, of its first document). Texts without any are left out.
    """
    first_stays = keep == "first"

    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, shift, texts in _parts(batch, length):
                text, a, b, p, m, c = regions(texts, length)
                a, b, p = a + shift, b + shift, p + shift
                key = batch.column("key").slice(at, len(texts)).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([key, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(m), pa.array(c)], names=["key", "a", "b", "p", "m", "c"])
        settle()

    region_rows = written(docs.select("key", "t").mapInArrow(find, "key binary, a int, b int, p int, m long, c long"))
    often = written(region_rows.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m"))  # so that the join can split a large partition
    shared = written(region_rows.join(often, "m"), instead_of=(region_rows, often))
    # the first document of each text
    owner = docs.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("doc_id"))
    if first_stays:
        shared = written(shared.join(owner, "key"), instead_of=(shared,))
        own = shared
    else:
        own, shared = shared, shared.withColumn("doc_id", F.lit(0).cast("long"))
    contents = written(shared.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "key", "b", "p")).alias("at")))
    copied = shared.join(contents.where("n > 1").select("m", "c", F.col("at.key").alias("first_key"), F.col("at.a").alias("first_a")), ["m", "c"])
    if first_stays:
        copied = copied.where("key <> first_key or a <> first_a")
    whole = written(copied.select("key", "a", (F.col("b") + length).alias("e")).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "e")).alias("spans")))

    kinds = contents.groupBy("m").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1" if first_stays else "kinds > 1 and least = 1")
    differ = contents.join(kinds.select("m", "kinds"), "m").select("m", "kinds", "at.key", "at.a", "at.b", "at.p")
    asked = differ.groupBy("key").agg(F.collect_list(F.struct("m", "a", "b", "p", "kinds")).alias("asked")).join(owner, "key")
    sources = docs.select("key", "t", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"))
    found = sources.join(asked, ["key", "doc_id"]).withColumn("r", F.explode("asked"))
    cut = written(found.select("r.m", "doc_id", "key", "r.a", "r.p", "r.kinds", F.expr(f"substring(t, r.a + 1, r.b - r.a + {length})").alias("t")))

    def part(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[tuple] = []
                for i, (m, a, p, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("m", "a", "p", "t")))):
                    found += [(i, x, key, content, t[x - a : y + length - a]) for x, y, key, content in parts(t, a, p, m, length, width)]
                row, first, key, content, data = zip(*found) if found else [()] * 5
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(batch.column(c).take(take) for c in ("doc_id", "key", "p")), pa.array(first, pa.int32()), pa.array(content, pa.int64()), pa.array(data, pa.binary())], names=["m", "doc_id", "key", "p", "a", "c", "t"])

        return run

    done = [own, contents, whole, cut]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _suffix_order(length, first_stays)
    gather = lambda rows: rows.select("m", "doc_id", "key", "a", "t").repartition(n, "m").sortWithinPartitions("m").mapInArrow(order, "key binary, a int, e int")
    ordered = gather(cut.where(F.col("kinds") <= many))
    rest = cut.where(F.col("kinds") > many)
    for width in WIDTHS:
        if not rest.limit(1).count():
            break
        split = written(rest.mapInArrow(part(width), "m long, doc_id long, key binary, p int, a int, c long, t binary"))
        same = split.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "a", "key")).alias("at"))
        same = written(same.join(same.groupBy("m").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).where("rows > 1"), "m"))
        done += [split, same]
        again = split.join(same.where("n > 1").select("m", "c", "at"), ["m", "c"])
        if first_stays:
            again = again.where("key <> at.key or a <> at.a")
        ordered = ordered.unionByName(again.select("key", "a", (F.col("a") + F.length("t")).alias("e")))
        one = split.join(same.where("kinds > 1").select("m", "c", "kinds", "at"), ["m", "c"]).where("key = at.key and a = at.a").select("m", "doc_id", "key", "a", "p", "kinds", "t")
        ordered = ordered.unionByName(gather(one.where(F.col("kinds") <= many)))
        rest = one.where(F.col("kinds") > many)

    partly = ordered.groupBy("key").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
    every = written(whole.unionByName(partly).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    forget(*done)
    return every


def _suffix_order(length: int, first_stays: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            own = list({(d, k, a): (t, k, a) for _, d, k, a, t in rows}.items())
            flags = repeated_starts([x[0] for _, x in own], [at for at, _ in own], length, first_stays)
            spans_ = [(k, a + i, a + j + length) for (_, (_, k, a)), f in zip(own, flags) for i, j in runs(f)]
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in spans_], pa.binary()), pa.array([s[1] for s in spans_], pa.int32()), pa.array([s[2] for s in spans_], pa.int32())], names=["key", "a", "e"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= ORDERED and row[0] != rows[-1][0]:
                    yield out()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield out()
            rows.clear()
        settle()

    return run


def marked(docs: DataFrame, length: int = LENGTH, keep: str = "none", id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """The rows of docs with the columns __t (the text's bytes), __key and __spans (null: nothing to remove).

    text_col None: docs has __t in the place of a text.
    """
    data = F.col("__t") if text_col is None else utf8(text_col)
    key = F.substring(F.unhex(F.sha2(data, 256)), 1, 16)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), data.alias("t"))
    found = spans(slim, length, keep).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    if keep == "first":
        found = found.join(slim.groupBy(F.col("key").alias("__key")).agg(F.min("doc_id").alias("__first")), "__key", "outer")
    rows = docs.withColumn("__key", key).join(found, "__key", "left").withColumn("__t", data)
    if keep == "first":
        later = (F.col(id_col).cast("long") > F.col("__first")) & (F.length("__t") >= length)
        everything = F.array(F.struct(F.lit(0).alias("a"), F.length("__t").alias("e")))
        rows = rows.withColumn("__spans", F.when(later, everything).otherwise(F.col("__spans")))
    return rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go), kept (bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in any document, overlaps
    included (keep="none"), or starts at an earlier position (keep="first"). Texts are UTF-8 bytes and judged as given.
    Null text: empty. Null doc_id: stays null, and last in order. Repeated rows are copies, so keep="none" removes
    them where they have `length` bytes; with keep="first" rows of one id and text count as one (those without an id
    stay, as the first of their text does). Ties: the smaller offset
    is earlier. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found in zip(batch.column("t"), batch.column("s")):
                data, found = data.as_py(), merged([(x["a"], x["e"]) for x in found.as_py() or []])
                at, rest = 0, []
                for a, b in found:
                    rest.append(data[at:a])
                    at = b
                kept = b"".join([*rest, data[at:]])
                out.append((len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in found], kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    rows = marked(docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("__t")), length, keep, text_col=None)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept binary"
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__t").alias("t"), F.col("__spans").alias("s")).mapInArrow(run, schema)


def without_later_copies(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """docs with its columns, later copies of repeated strings cut from the text (whole characters only)."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for data, s in zip(texts, found):
                data, at, rest = data.as_py(), 0, []
                for a, b in _to_characters(data, merged([(x["a"], x["e"]) for x in s.as_py() or []])):
                    rest.append(data[at:a])
                    at = b
                out.append(b"".join([*rest, data[at:]]).decode("utf-8", "replace"))
            yield pa.array(out, pa.string())

    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col("__t"), F.col("__spans")))
    return marked(docs, length, "first", text_col=text_col).withColumn(text_col, text).select(*docs.columns)
