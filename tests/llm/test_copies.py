"""Near copies: SimHash, embeddings, components, repeated strings, word shingles."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from fgspark.llm import components, embeddings, shingle_copies, simhash, suffix

DOCS = "doc_id bigint, text string, score double, fp string, key int, a int"  # extra columns with names the operators use


def rows(pairs):
    return [(i, t, None, "x", 1, None) for i, t in pairs]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 90])))) for i in range(n)]
    copies = [(n + i, out[i][1].replace(words[0], words[1], 1).upper() if i % 2 else out[i][1]) for i in range(0, 20)]
    return out + copies + [(500, None), (501, ""), (502, " \n "), (None, out[3][1]), (None, "only here"), (3, out[3][1])]


def union(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    label = union(150, real)
    assert got == {v: label[v] for p in real for v in p if label[v] != v}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def brute_fingerprint(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split(" ")
    w = [x for part in w for x in part.replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_close_pair():
    rng = random.Random(2)
    for radius in (1, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not difference & m for m in masks)


@pytest.mark.parametrize("block", [2048, 4])
def test_simhash_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    data = texts()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_copies(spark.createDataFrame(rows(data), DOCS)).collect())
    fp = [brute_fingerprint(t, 4) for _, t in data]
    label = union(len(data), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = collections.defaultdict(lambda: None)
    for (i, _), g in zip(data, label):
        if i is not None:
            least[g] = i if least[g] is None else min(least[g], i)
    assert got == sorted((i if i is not None else -1, f"{f:016x}", least[g]) for (i, _), f, g in zip(data, fp, label))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_copies(docs).count() == suffix.remove_repeats(docs).count() == shingle_copies.one_of_each(docs).count() == 0
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("block, pivots", [(2048, 1024), (8, 1024), (8, 2)])
def test_embeddings_against_all_pairs(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "MOST_PIVOTS", pivots)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, 6)) * 0.08, np.repeat(base[:2], 8, axis=0), base[:3] * 2])
    data = [(i, [float(x) for x in row], int(i % 3) if i < 40 else int((i - 40) % 3)) for i, row in enumerate(v)]
    data += [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, None, 0, 0, 0, 0], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] + [0.0] * 5, 1), (905, data[0][1], None), (906, data[0][1][:4], 0), (907, [], 0), (908, data[0][1], 0), (908, data[0][1], 0)]
    data = [(i, None if x is None else [None if y is None else float(y) for y in x], l) for i, x, l in data]
    ok = [i for i, (_, x, l) in enumerate(data) if l is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    pairs = [(i, j) for i in ok for j in ok if i != j and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]) and cos(data[i][1], data[j][1]) >= 0.98]
    label, count = union(len(data), pairs), collections.Counter(i for i, _ in pairs)
    least = {}
    for (i, _, _), g in zip(data, label):
        least[g] = min(least.get(g, i), i)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()))
    assert got == sorted((d[0], count[i], least[label[i]], d[0] == least[label[i]]) for i, d in enumerate(data))


def brute_repeats(docs, n, keep):
    seen = collections.defaultdict(list)
    raw = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in docs]
    for r, (i, b) in enumerate(raw):
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]].append((i, k, r))
    out = []
    for (i, b), (own, _) in zip(raw, docs):
        flags = bytearray(len(b))
        for k in range(len(b) - n + 1):
            at = seen[b[k : k + n]]
            if len(at) > 1 if keep == "none" else min(at)[:2] < (i, k):
                flags[k : k + n] = b"\1" * n
        kept = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(1 for j in range(len(b)) if flags[j] and (not j or not flags[j - 1]))
        out.append((-1 if own is None else own, len(b), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep, many", [("none", 2048), ("none", 2), ("first", 2048), ("first", 2)])
def test_repeated_strings_against_all_windows(spark, keep, many, monkeypatch):
    monkeypatch.setattr(suffix.spans, "__defaults__", (200, "none", many))
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    data = [(i, " ".join(rng.choice([rng.choice(passages), rng.choice(words), rng.choice(passages)[10:90]]) for _ in range(rng.randint(0, 7)))) for i in range(40)]
    data += [(70, data[3][1]), (72, None), (73, "x" * 300), (74, "ab" * 150), (75, "")] + ([(None, data[5][1]), (3, data[3][1])] if keep == "none" else [])
    got = suffix.remove_repeats(spark.createDataFrame(rows(data), DOCS), 60, keep).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_repeats(data, 60, keep)


@pytest.mark.parametrize("rounds", [48, 0])
def test_longest_previous(monkeypatch, rounds):
    monkeypatch.setattr(suffix, "ROUNDS", rounds)
    rng = random.Random(5)
    for _ in range(200):
        d = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 18)))
        order = sorted(range(len(d)), key=lambda i: d[i:])
        agree = lambda i, j: next((k for k in range(len(d)) if max(i, j) + k >= len(d) or d[i + k] != d[j + k]), len(d))
        common = [0] + [agree(i, j) for i, j in zip(order, order[1:])]
        length, source = suffix.longest_previous(np.array(order, dtype=np.int64), np.array(common[: len(d)], dtype=np.int64))
        assert length.tolist() == [max([0] + [agree(i, j) for j in range(i)]) for i in range(len(d))]
        assert all((s == -1) if n == 0 else (s < i and agree(i, s) == n) for i, (n, s) in enumerate(zip(length.tolist(), source.tolist())))


@pytest.mark.parametrize("length", [16, 60, 200])
def test_suffix_order(length):
    rng = random.Random(6)
    for _ in range(20):
        part = bytes(rng.choice(b"ab\x00\xff") for _ in range(70))
        d = b"".join(rng.choice([part, part[:40], bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 30)))]) for _ in range(12)) + b"z" * length
        where = np.arange(len(d) - length + 1)
        order, common = suffix.suffix_order(np.frombuffer(d, dtype=np.uint8), where, length)
        cut = [d[i : i + length] for i in where]
        assert order.tolist() == sorted(where.tolist(), key=lambda i: (cut[i], i))
        assert common.tolist() == [0] + [next((k for k in range(length) if cut[i][k] != cut[j][k]), length) for i, j in zip(order, order[1:])]


def test_texts_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef") for _ in range(900))
    texts = [passage + "x" * 50 + passage[100:700], "y" + passage[300:], "short"]
    whole = [suffix.regions([t.encode()], 200) for t in texts]
    monkeypatch.setattr(suffix, "PART", 333)
    rows = suffix.pa.RecordBatch.from_pydict({"t": [t.encode() for t in texts]})
    found = {0: set(), 1: set(), 2: set()}
    monkeypatch.setattr(suffix, "pieces", lambda batch, c: ((i, [t]) for i, t in enumerate(batch.column(c).to_pylist())))
    for at, shift, part in suffix._parts(rows, 200):
        _, a, b, p, m, _ = suffix.regions(part, 200)
        found[at] |= {(w + shift, q + shift, h) for x, y, q, h in zip(a.tolist(), b.tolist(), p.tolist(), m.tolist()) for w in range(x, y + 1)}
    for i, (_, a, b, p, m, _) in enumerate(whole):
        assert found[i] == {(w, q, h) for x, y, q, h in zip(a.tolist(), b.tolist(), p.tolist(), m.tolist()) for w in range(x, y + 1)}


def test_later_copies_are_cut_at_characters(spark):
    passage = "".join(chr(0xC0 + i) for i in range(120))  # two bytes a character
    docs = spark.createDataFrame([(1, "a" + passage), (2, "b" + passage + "c"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix.without_later_copies(docs).collect()}
    assert got == {1: "a" + passage, 2: "bc", 3: None}


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([80, 200, 400]))] for _ in range(30)]
    data = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        near = list(w)
        near[len(w) // 2] = "changed"
        data += [(100 + i, " ".join(near)), (200 + i, " ".join(w))]
    data += [(300, None), (301, ""), (None, data[0][1]), (None, "a text without an id"), (0, data[0][1])]
    got = shingle_copies.one_of_each(spark.createDataFrame(rows(data), DOCS))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    assert ids == [-1, *range(30), 300]


def edited(rng, words, kind, part):
    """A copy of the words with about `part` of their number added, cut or changed."""
    n = max(1, round(part * len(words)))
    extra, at = ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n)], rng.randrange(len(words))
    if kind == "swapped":
        out = list(words)
        for k, w in zip(rng.sample(range(len(out)), max(1, n // 5)), extra):
            out[k] = w
        return out
    return {"appended": words + extra, "prepended": extra + words, "inserted": words[:at] + extra + words[at:], "cut": words[n:]}[kind]


def jaccard(a, b, k=5):
    x, y = ({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def near_pairs(seed=11):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    kinds = ("appended", "prepended", "inserted", "cut", "swapped")
    return [(w, edited(rng, w, kind, rng.uniform(0.03, 0.45))) for kind in kinds for _ in range(60) for w in [[rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]]]


def linked_pairs(spark, pairs):
    """Of texts in pairs (1, 2), (3, 4), ..: whether the second goes as a near copy of the first."""
    data = [(2 * i + k, " ".join(w)) for i, p in enumerate(pairs) for k, w in enumerate(p)]
    left = {r.doc_id for r in shingle_copies.one_of_each(spark.createDataFrame(rows(data), DOCS)).collect()}
    assert left >= {2 * i for i in range(len(pairs))}
    return [2 * i + 1 not in left for i in range(len(pairs))]


@pytest.mark.parametrize("block", [2048, 4])
def test_all_edited_copies_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_copies, "BLOCK", block)
    pairs = [p for p in near_pairs() if jaccard(*p) >= 0.8]
    assert len(pairs) > 100 and all(linked_pairs(spark, pairs))


@pytest.mark.parametrize("sample", [128, 1])
def test_texts_below_the_similarity_stay(spark, monkeypatch, sample):
    monkeypatch.setattr(shingle_copies, "SAMPLE", sample)  # 1: all texts are looked at for frequent shingles
    monkeypatch.setattr(shingle_copies, "FREQUENT", 2)
    pairs = near_pairs(seed=12)
    similar = [jaccard(*p) >= 0.8 for p in pairs]
    assert sum(similar) > 100 and sum(0.65 <= jaccard(*p) < 0.8 for p in pairs) > 50
    assert linked_pairs(spark, pairs) == similar
