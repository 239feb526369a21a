"""The queries opN_<name> of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import table
from .embeddings import near_vectors
from .html import extract
from .merkle import PIECE, fingerprints
from .packing import pack
from .pii import pseudonymise
from .resampling import resample, target_rows
from .simhash import near_copies
from .suffix import remove_repeats
from .toxicity import toxicity, train

#: The key of these queries; a real run takes its own from a secret store.
PII_KEY = "fgspark-demo-key"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("spans", F.to_json("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), words=4, radius=4)


def op4_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample(docs, target_rows(docs, table(spark, sf_dir, "labels")), share=0.8)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=200, keep="none").drop("spans", "kept")


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_simhash, op4_resampling, op5_embeddings, op6_packing, op7_suffix, op8_merkle, op9_html, op10_bpe)}

#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op5_embeddings": """
        WITH RECURSIVE e AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        pairs AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
        FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id""",
    "op7_suffix": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS i FROM d),
        g AS (SELECT w.r, w.i, md5_number(substr(x, CAST(2 * w.i + 1 AS BIGINT), 400)) AS h FROM w JOIN d USING (r)),
        twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
        starts AS (SELECT r, i FROM g WHERE h IN (SELECT h FROM twice)),
        runs AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) AS before FROM starts)),
        spans AS (SELECT r, k, min(i) AS a, max(i) + 200 AS e FROM runs GROUP BY r, k),
        gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM spans),
        kept AS (SELECT d.r, any_value(x) AS x, count(a) AS n, coalesce(sum(e - a), 0) AS gone, string_agg(substr(x, CAST(2 * from_ + 1 AS BIGINT), CAST(2 * (a - from_) AS BIGINT)), '' ORDER BY a) AS head, max(e) AS tail FROM d LEFT JOIN gaps ON gaps.r = d.r GROUP BY d.r)
        SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(d.x, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM kept JOIN d USING (r)""",
    "op8_merkle": rf"""
        WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        nx AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM own WINDOW w AS (ORDER BY doc_id DESC)),
        ed AS (SELECT *, substr(text, 1, n - n // 2) || substr(nxt, 1, n // 2) AS edited FROM nx),
        texts AS (SELECT DISTINCT t FROM (SELECT text AS t FROM ed UNION ALL SELECT edited FROM ed)),
        li AS (SELECT t, list_transform(list_transform(string_split(t, chr(10)), lambda l: list_transform(regexp_extract_all(l, '{PIECE}'), lambda p: sha256(p)[1:16])), lambda h: [sha256('p' || array_to_string(h, ','))[1:16] || ':' || array_to_string(h, ',')]) AS p FROM texts),
        pa AS (SELECT t, list_transform(p, lambda x: x[1]) AS p, list_transform(p, lambda x: x[1][1:16]) AS h FROM li),
        se AS (SELECT t, p, h, list_filter(regexp_extract_all(array_to_string(h, ''), '(?:[0-9a-f]{{15}}[4-9a-f])*(?:[0-9a-f]{{15}}[0-3]|$)'), lambda s: length(s) > 0) AS s FROM pa),
        fp AS (SELECT t, h, sha256('r' || array_to_string(list_transform(s, lambda x: sha256('s' || x)[1:16]), '')) || '|' || array_to_string(list_transform(p, lambda x: x || CASE WHEN x[16:16] IN ('0', '1', '2', '3') THEN '/' ELSE ';' END), '') AS f,
        list_distinct(flatten(list_transform(p, lambda x: list_filter(string_split(x[18:], ','), lambda y: y <> '')))) AS b FROM se),
        j AS (SELECT doc_id, n, edited, a.f AS fa, e.f AS fe, a.b AS ba, e.b AS be, x.b AS bx, x.f AS fx, a.h AS ha, e.h AS he, least(len(a.h), len(e.h)) AS m FROM ed JOIN fp a ON a.t = text JOIN fp e ON e.t = edited JOIN fp x ON x.t = nxt),
        k AS (SELECT *, coalesce(list_position(list_transform(range(1, m + 1), lambda i: ha[i] = he[i]), false) - 1, m) AS st FROM j)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fe AS edited_fingerprint,
        CASE WHEN fa[1:64] = fe[1:64] THEN 1.0::DOUBLE WHEN len(ba) + len(be) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(ba, be)) / (len(ba) + len(be)) END AS near_edited,
        CASE WHEN fa[1:64] = fx[1:64] THEN 1.0::DOUBLE WHEN len(ba) + len(bx) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(ba, bx)) / (len(ba) + len(bx)) END AS near_next,
        CAST(st AS INTEGER) AS edited_start, CAST(len(he) - coalesce(list_position(list_transform(range(0, m - st), lambda i: ha[len(ha) - i] = he[len(he) - i]), false) - 1, m - st) AS INTEGER) AS edited_stop FROM k""",
}
