"""Vectors as whole numbers: what operators 12 and 13 read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_lineage


def whole_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``(id, <extra as e0, e1, ...>, x array<long>)``, written, and the length of every ``x``.

    ``x`` is ``floor(scale * component)`` of every component as double; what lies beyond a long
    counts as its nearest end. Rows whose vector is null or holds null or non-finite components
    are dropped. Vectors shorter than the longest are padded with zeros, so every row has the
    same length (0 if there are no rows). Repeated rows and null identifiers stay.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    kept = df.where(vector.isNotNull() & F.forall(vector, finite)).select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"e{i}") for i, c in enumerate(extra)],
        F.transform(vector, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"),
    )
    kept = cut_lineage(kept)
    sizes = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    width = sizes[1] or 0
    if sizes[0] not in (None, width):
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
        kept = kept.withColumn("x", F.concat("x", zeros))
    return kept, width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A block of ``x`` as an integer matrix, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)
