"""The pipeline's near-copy stage links what SimHash links, beside what similar shingle sets do."""

import random

import corpus_pipeline
import numpy as np

from fgspark.llm import shingle_copies, simhash


def similarity(a, b):
    x, y = (shingle_copies.shingles(t.encode()) for t in (a, b))
    both = len(np.intersect1d(x, y))
    return both / (len(x) + len(y) - both)


def test_near_fingerprints_link(spark):
    rng, pairs = random.Random(4), []
    while len(pairs) < 2:  # near fingerprints of less similar shingle sets
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = [f"x{i}" if i % 25 == 12 else w for i, w in enumerate(words)]
        a, b = " ".join(words), " ".join(other)
        if similarity(a, b) < 0.8 and (simhash.fingerprint(a.encode(), 4) ^ simhash.fingerprint(b.encode(), 4)).bit_count() <= 4:
            pairs.append((a, b))
    (a, b), (c, d) = pairs
    e = d + " a tail of six words more"  # reached from c by a fingerprint, then by shingles
    assert similarity(d, e) >= 0.8
    docs = spark.createDataFrame(list(enumerate([a, b, c, d, e, "alone in here", None, ""])), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, 2, 5, 6}
    named = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert all(named[i] == i for i in kept)
