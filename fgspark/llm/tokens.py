"""Splitting of text ahead of byte-level BPE, a whole batch of texts at a time, and a cache of what each piece gives.

The pattern that public rank files come with takes, from left to right: a contraction ('s 't 're 've 'm 'll 'd); an
optional space and a run of letters, of numbers or of other characters; white space up to the last character ahead of
something else; white space. That is decided here from the classes of neighbouring characters, for all characters of a
batch at once. Equal pieces are then found by a hash and compared with what is kept under it, so that only new ones are
encoded and no two different pieces pass for one.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
EDGE_CHAR = 0x110000
#: White space of Unicode, fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces, and characters of them, that the cache holds before it starts anew.
CACHED, CACHED_CHARS = 1_500_000, 1 << 23


@cache
def classes() -> np.ndarray:
    """The class of every code point, and of EDGE_CHAR."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)] + [EDGE], dtype=np.uint8)
    out[WHITE] = SPACE
    return out


def starts_of(c: np.ndarray) -> np.ndarray:
    """Where pieces start in code points c; each text ends in an EDGE_CHAR, which is a piece by itself."""
    k = classes()[c]
    start = np.empty(len(c), dtype=bool)
    start[0] = True
    before, here = k[:-1], k[1:]
    start[1:] = (before != here) | (here == EDGE)
    after_white = np.flatnonzero((before == SPACE) & (here != SPACE) & (here != EDGE)) + 1
    start[after_white - 1] = True
    start[after_white] = c[after_white - 1] != 0x20
    for i in np.flatnonzero((c == 0x27) & start).tolist():
        after = c[i + 1 : i + 3].tolist()
        q = 1 if after and chr_at(after, 0) in "stmd" else 2 if len(after) == 2 and chr_at(after, 0) + chr_at(after, 1) in ("re", "ve", "ll") else 0
        if q:
            start[i + 1 : i + 1 + q] = False
            start[i + 1 + q] = True
    return np.flatnonzero(start)


def chr_at(codes: list[int], i: int) -> str:
    return chr(codes[i]) if codes[i] < EDGE_CHAR else "\n"


@cache
def noise() -> np.ndarray:
    """64 mixed bits for every code point, so that a sum of them times powers tells pieces apart."""
    v = np.arange(EDGE_CHAR + 1, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for shift, factor in ((33, 0xD6E8FEB86659FD93), (32, 0xA0761D6478BD642F), (29, 0xE7037ED1A0B428DB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return v


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.room, self.n = np.empty(1 << 10, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            room = np.empty(max(n, 2 * len(self.room)), dtype=self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def positions(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (sizes[0] of them), starts[1], .."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """Encodes batches of texts; encode(pieces) gives the ids of new ones. Its memory is bounded by CACHED and CACHED_CHARS
    and the largest batch."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.known, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flat, self.chars = Growing(np.uint32), Growing(np.uint32)
        self.size, self.at, self.length, self.begin = (Growing(np.int64) for _ in range(4))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            base, one = 0x9E3779B97F4A7C15, np.ones(1, dtype=np.uint64)
            self.power, self.inverse = (np.cumprod(np.concatenate([one, np.full(n - 1, x, dtype=np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
        return self.power, self.inverse

    def add(self, texts: list[str]) -> np.ndarray:
        """Encodes pieces and keeps them. Returns their numbers."""
        lists = self.encode(texts)
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        number = self.size.n + np.arange(len(lists))
        self.at.extend(self.flat.n + np.cumsum(size) - size)
        self.begin.extend(self.chars.n + np.cumsum(length) - length)
        self.size.extend(size)
        self.length.extend(length)
        self.flat.extend(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum())))
        self.chars.extend(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        return number

    def number(self, hashes: np.ndarray, c: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each piece, the code points c[start : start + size] with the given hash."""
        text = lambda i: c[start[i] : start[i] + size[i]].tobytes().decode("utf-32-le", "surrogatepass")
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        found = self.place[at] if len(self.known) else np.zeros(len(unique), dtype=np.int64)
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            found[new] = self.add([text(i) for i in first[new].tolist()])
            into = np.searchsorted(self.known, unique[new])
            self.known, self.place = np.insert(self.known, into, unique[new]), np.insert(self.place, into, found[new])
        number = found[back]
        same = self.length.all[number] == size
        i = np.flatnonzero(same)
        differs = c[positions(start[i], size[i])] != self.chars.all[positions(self.begin.all[number[i]], size[i])]
        if differs.any():
            same[i[np.repeat(np.arange(len(i)), size[i])[differs]]] = False
        if not same.all():  # another piece has the hash already; such ones are encoded in each batch
            wrong = np.flatnonzero(~same)
            texts = [text(i) for i in wrong.tolist()]
            own = dict(zip(dict.fromkeys(texts), self.add(list(dict.fromkeys(texts))).tolist()))
            number[wrong] = [own[t] for t in texts]
        return number

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if self.size.n > CACHED or self.chars.n > CACHED_CHARS:
            self.clear()
        joined = "".join(texts)
        c = np.full(len(joined) + len(texts), EDGE_CHAR, dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        inside = np.ones(len(c), dtype=bool)
        inside[ends] = False
        c[inside] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        start = starts_of(c)
        stop = np.append(start[1:], len(c))
        real = c[start] != EDGE_CHAR
        start, stop = start[real], stop[real]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        power, inverse = self.powers(len(c) + 1)
        total = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(noise()[c] * power[: len(c)], out=total[1:])
        piece = self.number((total[stop] - total[start]) * inverse[start], c, start, stop - start)
        size = self.size.all[piece]
        ids = self.flat.all[positions(self.at.all[piece], size)]
        until = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, ends)]
        return ids, np.diff(until, prepend=0)
