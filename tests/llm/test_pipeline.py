"""The pipeline's stages on the smallest tables, and its parts against brute force."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fgspark.llm import packing, pii, queries, toxicity
from tests.conftest import DATA


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, str(DATA))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            tagger = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {r.doc_id for r in toxicity.toxicity(before, tagger).where("predicted = 0").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if name == "simhash":
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts) and set(r.text for r in before.collect()) >= set(texts)
            assert docs.count() > 0.6 * before.count()
        if name == "suffix":
            old, seen, left = {r.doc_id: r.text for r in before.collect()}, set(), {}
            for i in sorted(old):  # what stays of each text, byte by byte, earlier documents first
                b = old[i].encode()
                gone = bytearray(len(b))
                for k in range(len(b) - 199):
                    if b[k : k + 200] in seen:
                        gone[k : k + 200] = b"\1" * 200
                    seen.add(b[k : k + 200])
                left[i] = sum(gone)
            for r in docs.collect():
                cut = len(old[r.doc_id].encode()) - len(r.text.encode())
                assert 0 <= left[r.doc_id] - cut <= 6 * (1 + left[r.doc_id] // 200)  # parts of characters stay
                assert r.n_chars == len(r.text)
        if name == "pii":
            assert docs.exceptAll(pii.pseudonymise(before, queries.PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*columns)).count() == 0
    pieces = kept["packing"].orderBy("doc_id", "start").toPandas()
    known = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for r in kept["pii"].limit(30).collect():
        own = pieces[pieces.doc_id == r.doc_id]
        assert np.concatenate(own.ids.tolist()).tolist() == known.encode(r.text, add_special_tokens=False).ids + [0]
        assert own.length.tolist() == packing.binary_lengths(int(own.doc_tokens.iloc[0]))


def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix", "pii", "packing"]
