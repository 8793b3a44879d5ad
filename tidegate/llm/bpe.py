"""Operator 1: byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks
from tidegate.llm.pieces import RankEncoder, tiktoken_encoding


def encode(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text: ``(id_col, n_tokens long, ids binary)``.

    ``ids`` holds little-endian unsigned 32-bit integers; ``ids_array`` unpacks them. A null or
    empty text has no ids. Rows map one to one, repeated rows and null keys included; other
    columns are not read, so their names do not matter. ``ranks`` is a path every executor has.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        encoder = RankEncoder(ranks, pattern)

        def run(keys, texts):
            packed = [encoder.packed(text) for text in texts]
            return {"k": keys, "n_tokens": [len(p) // 4 for p in packed], "ids": packed}

        return run

    out = map_blocks(docs.select(F.col(id_col), F.col(text_col)), f"k {key}, n_tokens long, ids binary", make)
    return out.withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Raw bytes of packed ids: ``(id_col, n_tokens, ids, decoded binary)``.

    Ids may end inside a character, so the bytes need not be valid UTF-8. Null ids count as
    none. An id without a rank raises.
    """
    key = encoded.schema[id_col].dataType.simpleString()

    def make():
        encoding = tiktoken_encoding(ranks, pattern)
        table = {encoding.encode_single_token(t): t for t in encoding.token_byte_values()}

        def run(keys, counts, packed):
            ids = [np.frombuffer(p or b"", dtype="<u4").tolist() for p in packed]
            return {
                "k": keys, "n_tokens": counts, "ids": packed,
                "decoded": [b"".join(map(table.__getitem__, i)) for i in ids],
            }

        return run

    out = map_blocks(
        encoded.select(F.col(id_col), "n_tokens", "ids"),
        f"k {key}, n_tokens long, ids binary, decoded binary", make,
    )
    return out.withColumnRenamed("k", id_col)


def ids_array(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Packed ids as ``(id_col, ids array<long>)``."""
    key = encoded.schema[id_col].dataType.simpleString()

    def make():
        def run(keys, packed):
            return {"k": keys, "ids": [np.frombuffer(p or b"", dtype="<u4").tolist() for p in packed]}

        return run

    out = map_blocks(encoded.select(F.col(id_col), "ids"), f"k {key}, ids array<long>", make)
    return out.withColumnRenamed("k", id_col)
