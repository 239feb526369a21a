"""Byte-level BPE by prefix dynamic programming: every byte prefix keeps the one token that can end it."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8
from .tokens import Pieces


class Ranks:
    """A vocabulary of byte strings by rank, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.next: dict[int, dict[int, int]] = {0: {}}  # a trie: node -> byte -> node
        self.token: dict[int, int] = {}  # node -> token that ends there
        self.halves: dict[int, tuple[int, int]] = {}  # what the last merge of a token joins
        for t, i in ranks.items():
            if len(t) > 1:
                parts = self.merged(t, i)
                if len(parts) != 2 or self.merged(t) != [i]:
                    continue  # merges never make it; only a whole piece can be it
                self.halves[i] = parts[0], parts[1]
            node = 0
            for b in t:
                here = self.next[node]
                if b not in here:
                    here[b] = len(self.next)
                    self.next[here[b]] = {}
                node = here[b]
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes, below: int = 1 << 61) -> list[int]:
        """BPE as it is defined, merge by merge, up to the first merge of rank `below`; used on tokens only."""
        never, rank_of = 1 << 62, self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = [rank_of(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < below:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], never)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], never)
        return [self.ranks[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together gives a and b again."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Goes back through the merges that made a and b, the latest first.

        Two tokens x, y meet at the border from when both are there until the next merge takes one of them in. Had the
        pair xy a rank ahead of that merge, it would have merged across the border. Of equal ranks the left goes first.
        """
        text, rank, halves, until = self.text, self.ranks, self.halves, 1 << 62
        while True:
            across = rank.get(text[a] + text[b])
            if across is not None and across < until:
                return False
            made_a, made_b = (x if x in halves else -1 for x in (a, b))
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                until, a = made_a, halves[a][1]
            else:
                until, b = made_b + 1, halves[b][0]


class PrefixEncoder:
    """Ids of a growing byte string. last[i] is the last token of the encoding of the first i bytes.

    A token may follow another only if the pair fits; a sequence in which all neighbours fit is the encoding, and each
    prefix has one. So appending bytes never changes an earlier entry, and an edit costs the bytes from it on.
    """

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last, self.open = ranks, bytearray(), [-1], []
        self.append(data)

    def append(self, data: bytes) -> None:
        r, last = self.ranks, self.last
        step, token, fit, text = r.next, r.token, r.fit, r.text
        for b in data:
            self.open.append((len(self.data), 0))
            self.data.append(b)
            still, found = [], -1
            for start, node in self.open:  # tokens that began at `start` and go on; the earliest first
                if (to := step[node].get(b)) is None:
                    continue
                still.append((start, to))
                if found < 0 and (t := token.get(to)) is not None and (start == 0 or fit(last[start], t)):
                    found = t
            if found < 0:
                raise ValueError(f"no token ends in byte {b}")
            self.open = still
            last.append(found)

    def cut(self, n: int) -> None:
        """Keeps the first n bytes."""
        del self.data[n:], self.last[n + 1 :]
        self.open = []
        step, most = self.ranks.next, max(map(len, self.ranks.ranks))
        for start in range(max(0, n - most), n):
            node = 0
            for b in self.data[start:n]:
                if (node := step[node].get(b, -1)) < 0:
                    break
            else:
                self.open.append((start, node))

    def replace(self, start: int, stop: int, data: bytes) -> None:
        """Bytes start to stop become data. After the edit, entries are taken over as soon as they must agree again."""
        tail, old = bytes(self.data[stop:]), self.last[stop + 1 :]
        self.cut(start)
        self.append(data)
        same, most = 0, max(map(len, self.ranks.ranks))
        for k, b in enumerate(tail):
            self.append(bytes([b]))
            same = same + 1 if self.last[-1] == old[k] else 0
            if same >= most:  # every later token starts where entries agree already
                self.data += tail[k + 1 :]
                self.last += old[k + 1 :]
                self.cut(len(self.data))
                return

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.ranks.text[out[-1]])
        return out[::-1]


def encode_piece(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one piece of the pattern; a piece that is a token is that token.

    The same table of last tokens as PrefixEncoder's, filled from each start on instead of byte by byte.
    """
    if (whole := ranks.ranks.get(piece)) is not None:
        return [whole]
    n, step, token, pairs, fit = len(piece), ranks.next, ranks.token, ranks.pairs, ranks.fit
    last, came = [-1] * (n + 1), [0] * (n + 1)
    for i in range(n):
        before, node, j = last[i], step[0], i
        while j < n and (at := node.get(piece[j])) is not None:
            j += 1
            node = step[at]
            if last[j] < 0 and (t := token.get(at)) is not None and (not i or (ok := pairs.get((before, t))) or (ok is None and fit(before, t))):
                last[j], came[j] = t, i
    out = []
    while n:
        out.append(last[n])
        n = came[n]
    return out[::-1]


@cache
def load(path: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


@cache
def cached(path: str) -> Pieces:
    ranks = load(path)
    return Pieces(lambda words: [encode_piece(ranks, w.encode()) for w in words])


def decode(path: str, ids: list[int]) -> bytes:
    """The bytes of the ids, as many as they are; they need not be valid UTF-8."""
    text = load(path).text
    return b"".join([text[i] for i in ids])


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    Null or empty text: no ids. Null doc_id stays null. Repeated rows stay. An empty table gives no rows. Other columns
    are not read. Texts are taken whole, one batch of about half a megabyte or one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached(ranks_path)
        for batch in batches:
            for first, texts in pieces(batch, "t", 1 << 19):
                flat, sizes = encode.ids([t.decode("utf-8", "replace") for t in texts])
                ends = np.cumsum(sizes)
                listed, sha, back = flat.tolist(), [], []
                for start, end in zip((ends - sizes).tolist(), ends.tolist()):
                    ids = listed[start:end]
                    sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(decode(ranks_path, ids)).hexdigest())
                out = [batch.column("doc_id").slice(first, len(texts)), pa.array(sizes), pa.array(sha), pa.array(back)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, schema)
