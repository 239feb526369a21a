"""Toxic spans by a linear-chain conditional random field over words; its marginals give document scores and offsets."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import moebius_scan, runs, settle

WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.7
#: Bounds of the sample that the tagger is fitted on: labelled rows of each kind, and characters of a row.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1000, 2000, 3000
#: Words that the score cache holds before it starts anew.
CACHED = 100_000


def features(word: str) -> list[str]:
    """Features of one word: itself, its beginnings, its end and length. Neighbours act through the chain."""
    w = word.lower()
    return [f"={w}", f"#{min(len(w), 12)}", f"-{w[-4:]}", *(w[:n] for n in BEGINNINGS if len(w) >= n)]


@dataclass
class Tagger:
    """Weights of a 2-label chain. Label 0 and its step 0-0 weigh nothing; `steps` are 0-1, 1-0, 1-1 and the start in 1."""

    weights: dict[str, float]
    steps: np.ndarray
    bias: float = 0.0
    cache: dict[str, float] = field(default_factory=dict)

    def emission(self, words: list[str]) -> np.ndarray:
        """The weight of label 1 at each word."""
        cache, weight, bias = self.cache, self.weights.get, self.bias
        if len(cache) > CACHED:
            cache.clear()
        for word in set(words).difference(cache):
            w = word.lower()
            n = len(w)
            e = bias + weight("=" + w, 0.0) + weight(f"#{n if n < 12 else 12}", 0.0) + weight("-" + w[-4:], 0.0)
            for k in BEGINNINGS:
                if n < k:
                    break
                e += weight(w[:k], 0.0)
            cache[word] = e
        return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))

    def messages(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward ratios (label 1 to label 0) at each word, and the marginal of label 1."""
        e = np.exp(np.clip(emission, -40, 40))
        t01, t10, t11, s1 = np.exp(np.clip(self.steps, -20, 20))
        go = (~first).astype(np.float64)
        forward = moebius_scan(e * t11 * go, e * np.where(first, s1, t01), t10 * go, np.ones(len(e)))
        # backward: q[t] = (t10 + t11 e' q') / (1 + t01 e' q'), 1 at a text's end
        last = np.append(first[1:], True)[::-1]
        ahead = np.append(e[1:], 0.0)[::-1]
        backward = moebius_scan(np.where(last, 0, t11 * ahead), np.where(last, 1, t10), np.where(last, 0, t01 * ahead), np.ones(len(e)))[::-1]
        both = forward * backward
        return forward, backward, both / (1 + both)

    def marginals(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(words of each text, ends of the texts among all words, marginals of all words)."""
        words = [WORD.findall(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        flat = [x for w in words for x in w]
        first = np.zeros(len(flat), dtype=bool)
        first[[e - len(w) for e, w in zip(ends, words) if w]] = True
        return words, ends, self.messages(self.emission(flat), first)[2] if flat else np.zeros(0)


def stems(counts: dict[str, int]) -> set[str]:
    """Word beginnings that stand for a family: 3 words or more have them, and none is over half of the occurrences."""
    total, most, kinds = Counter(), Counter(), Counter()
    for w, n in counts.items():
        for k in BEGINNINGS:
            if len(w) >= k:
                total[w[:k]] += n
                kinds[w[:k]] += 1
                most[w[:k]] = max(most[w[:k]], n)
    return {p for p, n in kinds.items() if n >= 3 and 2 * most[p] <= total[p]}


def seeds(toxic: list[str], clean: list[str]) -> set[str]:
    """Words and stems (4 to 6 letters) that mark toxic texts: in at least 4 and 2 % of them, at 20 times the rate of
    clean ones. Equal texts count once."""
    texts = [*dict.fromkeys(toxic), *dict.fromkeys(clean)]
    families = stems(Counter(w for t in texts for w in {w.lower() for w in WORD.findall(t)}))

    def count(texts: list[str]) -> Counter:
        found: Counter = Counter()
        for t in dict.fromkeys(texts):
            words = {w.lower() for w in WORD.findall(t)}
            found.update({w + "$" for w in words} | {w[:n] for w in words for n in (4, 5, 6) if len(w) >= n and w[:n] in families})
        return found

    n1, n0 = len(set(toxic)) or 1, len(set(clean)) or 1
    have, lack = count(toxic), count(clean)
    return {k for k, n in have.items() if n >= max(4, 0.02 * n1) and n / n1 >= 20 * (lack[k] + 0.5) / n0}


def is_seed(word: str, keys: set[str]) -> bool:
    w = word.lower()
    return w + "$" in keys or any(w[:n] in keys for n in (4, 5, 6) if len(w) >= n)


def fit(toxic: list[str], clean: list[str], rounds: int = 40, rate: float = 0.25, decay: float = 1e-3) -> Tagger:
    """Words of the toxic texts are labelled by seeds(), all of the clean ones 0; maximum likelihood by Adam."""
    steps = np.array([-3.0, 0.0, -1.0, -3.0])
    keys = seeds(toxic, clean)
    words = [(WORD.findall(t), y) for y, texts in ((1, toxic), (0, clean)) for t in texts]
    words = [(w, y) for w, y in words if w]
    if not keys or not words:
        return Tagger({}, steps, -9.0)
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(x, len(index)) for w, _ in words for x in w])
    first = np.zeros(len(flat), dtype=bool)
    first[np.cumsum([0] + [len(w) for w, _ in words[:-1]])] = True
    marked = np.array([is_seed(x, keys) for x in index])
    y = (marked[flat] & np.repeat([label == 1 for _, label in words], [len(w) for w, _ in words])).astype(np.float64)
    families = stems(Counter(x.lower() for w, _ in words for x in w))
    rows = [[f for f in features(x) if f[0] in "=#-" or f in families] for x in index]
    names: dict[str, int] = {}
    owner, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([names.setdefault(f, len(names)) for r in rows for f in r])
    weights = np.zeros(len(names))
    tagger = Tagger({}, steps)
    inside = ~first[1:]
    seen = np.array([((1 - y[:-1]) * y[1:])[inside].sum(), (y[:-1] * (1 - y[1:]))[inside].sum(), (y[:-1] * y[1:])[inside].sum(), y[first].sum()])
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros(4), np.zeros(4)]
    for k in range(1, rounds + 1):
        emission = np.bincount(owner, weights=weights[feature], minlength=len(rows))[flat]
        forward, backward, p = tagger.messages(emission, first)
        e, (t01, t10, t11, _) = np.exp(np.clip(emission, -40, 40)), np.exp(steps)
        a, q = forward[:-1], e[1:] * backward[1:]
        z = 1 + t01 * q + t10 * a + t11 * a * q
        expected = np.array([(t01 * q / z)[inside].sum(), (t10 * a / z)[inside].sum(), (t11 * a * q / z)[inside].sum(), p[first].sum()])
        by_word = np.bincount(flat, weights=p - y, minlength=len(rows))
        gradients = np.bincount(feature, weights=by_word[owner], minlength=len(weights)) + decay * weights, expected - seen + decay * steps
        for target, g, j in ((weights, gradients[0], 0), (steps, gradients[1], 2)):
            state[j] = 0.9 * state[j] + 0.1 * g
            state[j + 1] = 0.99 * state[j + 1] + 0.01 * g * g
            target -= rate * (state[j] / (1 - 0.9**k)) / (np.sqrt(state[j + 1] / (1 - 0.99**k)) + 1e-8)
    return Tagger({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-3}, steps)


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Tagger:
    """Fits a tagger on at most max_toxic and max_clean labelled rows that are not held out, of at most max_chars characters.

    The rows are the first by a hash of doc_id. Labels that are null or rows of documents without a text are passed
    over; of several labels of one id the greatest counts. Without toxic rows every word scores low.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("y"))
    chosen = None
    for y, most in ((1, max_toxic), (0, max_clean)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).where(F.length("t") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("t").alias("t")).collect()  # bounded by the limits above
    rows.sort(key=lambda r: r.id)
    return fit([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0])


def score_column(docs: DataFrame, tagger: Tagger, text_col: str = "text", spans: bool = True) -> Column:
    """struct(score, spans): the greatest marginal of a text's words, and the offsets (start, end, marginal) of runs of
    words that are likelier toxic than not.

    Null and empty texts score 0 and have no spans. Offsets count code points. A text is scored whole; texts are taken
    together up to about a megabyte.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tagger.weights, tagger.steps, tagger.bias))
    span_type = "array<struct<start:int,end:int,p:float>>"

    def offsets(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        found: list[list] = []
        before = False
        for m, x in zip(WORD.finditer(text), p.tolist()):
            if x >= 0.5 and before:
                found[-1][1:] = [m.end(), max(x, found[-1][2])]
            elif x >= 0.5:
                found.append([m.start(), m.end(), x])
            before = x >= 0.5
        return [tuple(x) for x in found]

    @F.arrow_udf(f"struct<score:double,spans:{span_type}>" if spans else "double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Tagger(*shared.value)
        for batch in batches:
            scores, found = [], []
            for first, stop in runs(batch, 1 << 20):
                texts = [t or "" for t in batch.slice(first, stop - first).to_pylist()]
                _, ends, p = model.marginals(texts)
                begin = 0
                for text, end in zip(texts, ends.tolist()):
                    own = p[begin:end]
                    top = float(own.max()) if len(own) else 0.0
                    scores.append(top)
                    if spans:
                        found.append([dict(zip(("start", "end", "p"), s)) for s in offsets(text, own)] if top >= 0.5 else [])
                    begin = end
            out = pa.array(scores, pa.float64())
            if spans:
                out = pa.StructArray.from_arrays([out, pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())])))], names=["score", "spans"])
            yield out
        settle()

    return run(F.col(text_col).cast("string"))


def toxicity(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans: a row per row of docs, repeated rows too; a null doc_id is not held out."""
    found = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, tagger, text_col).alias("found"))
    score = F.col("found.score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), F.col("found.spans").alias("spans"))
