"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, and equal lengths share a bucket."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, utf8
from .tokens import Pieces

MAX_LENGTH = 1024
END_ID = 0


@cache
def byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def encoder(path: str):
    """(cached piece encoder, special token texts, whole-text encoder) of a byte-level vocabulary file.

    New pieces are merged by the ranks in the file (ids of such files count up in the order of merges). Texts that hold
    a special token's characters go to the tokenizers library as they are.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(byte_of()[ch] for ch in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    whole = Tokenizer.from_file(path)
    return Pieces(lambda words: [merge(w.encode()) for w in words]), special, lambda text: whole.encode(text, add_special_tokens=False).ids


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, without special tokens being added."""
    cached, special, whole = encoder(path)
    ids, sizes = cached.ids(texts)
    out = np.split(ids, np.cumsum(sizes)[:-1])
    for i, text in enumerate(texts):
        if any(s in text for s in special):
            out[i] = np.array(whole(text), dtype=np.uint32)
    return out


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, none above `most` (a power of two), largest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, vocabulary: str, max_length: int = MAX_LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    A document is its text's ids and an end id (0). A piece's length is a power of two up to max_length, so a piece is a
    whole sequence by itself: sequences are gapless, need no padding and never hold two documents. Equal lengths share
    a bucket (log2 of the length), from which batches are drawn. A row of docs costs no shuffle and only its own memory.
    A null or empty text gives one piece with the end id. A null doc_id stays null. Repeated rows are documents of
    their own. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "t", 1 << 19):
                rows: list[tuple] = []
                for i, ids in enumerate(encode_texts(vocabulary, [t.decode("utf-8", "replace") for t in texts])):
                    raw, n = np.append(ids, END_ID).astype("<u4").tobytes(), len(ids) + 1
                    at = 0
                    for size in binary_lengths(n, max_length):
                        part = raw[4 * at : 4 * (at + size)]
                        rows.append((first + i, at, size, zlib.crc32(part), n, size.bit_length() - 1, part))
                        at += size
                doc, start, length, crc, total, bucket, part = zip(*rows)
                out = [batch.column("doc_id").take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(bucket, pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    ends = np.cumsum([0, *length]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(part), dtype="<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, schema)
    return found.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
