"""Operator 9: exact top-k search by pivot-table elimination.

Distances of every vector to a fixed set of pivots are computed once and stored. For a query,
the triangle inequality at the best pivot bounds each candidate's distance from below, and so
its inner product from above. Candidates are evaluated in the order of their bounds until the
next bound is below the k-th best score found, which makes the result exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.arrow import map_blocks
from tidegate.session import cut_lineage

#: Pivots: the vectors with the smallest hashes of their identifiers, a sample of fixed size.
PIVOTS = 64
#: Vectors of a block, on average, on either side; what one task compares.
QUERY_BLOCK, CANDIDATE_BLOCK = 1_024, 1_024
#: Candidates evaluated between two looks at the bounds.
STEP = 64
#: Widens a bound against rounding, relative to the norms it comes from; distances are stored in single precision.
SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, dim, v binary)``: floor(scale * x) as 64-bit integers.

    Rows with a null identifier, a null vector, or a null or non-finite component are left out.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )

    def make():
        def run(ids, rows):
            return {
                "id": ids, "dim": [len(r) for r in rows],
                "v": [np.floor(scale * np.asarray(r, dtype=np.float64)).astype("<i8").tobytes() for r in rows],
            }

        return run

    return map_blocks(whole, "id long, dim int, v binary", make, 4096)


def pivot_table(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``points`` with ``near``: single-precision distances to the pivots of the same dimension."""

    def make():
        def run(ids, dims, packed):
            near = []
            for dim, p in zip(dims, packed):
                v = np.frombuffer(p, "<i8").astype(np.float64)
                near.append(np.sqrt(((pivots[dim] - v) ** 2).sum(axis=1)).astype("<f4").tobytes() if dim in pivots else b"")
            return {"id": ids, "dim": dims, "v": packed, "near": near}

        return run

    return map_blocks(points.select("id", "dim", "v"), "id long, dim int, v binary, near binary", make, 4096)


def best_of(
    query_ids: np.ndarray, queries: np.ndarray, query_near: np.ndarray,
    ids: np.ndarray, points: np.ndarray, near: np.ndarray, k: int,
) -> tuple[list[int], list[int], list[int]]:
    """The ``k`` best candidates of a block for each query: (query, candidate, score) lists."""
    out: tuple[list, list, list] = ([], [], [])
    square = (points.astype(np.float64) ** 2).sum(axis=1)
    for query_id, query, own_near in zip(query_ids.tolist(), queries, query_near):
        own = float((query.astype(np.float64) ** 2).sum())
        lower = np.abs(near - own_near).max(axis=1) if near.shape[1] else np.zeros(len(ids))
        lower = np.maximum(0.0, lower - SLACK * (1 + np.sqrt(own) + np.sqrt(square)))
        upper = (own + square - lower**2) / 2 + SLACK * (1 + own + square)
        order = np.argsort(-upper, kind="stable")
        order = order[ids[order] != query_id]
        top_ids, top_scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for at in range(0, len(order), STEP):
            if len(top_scores) == k and upper[order[at]] < top_scores[-1]:
                break
            part = order[at : at + STEP]
            all_ids = np.concatenate([top_ids, ids[part]])
            all_scores = np.concatenate([top_scores, points[part] @ query])
            best = np.lexsort((all_ids, -all_scores))[:k]
            top_ids, top_scores = all_ids[best], all_scores[best]
        out[0].extend([query_id] * len(top_ids))
        out[1].extend(top_ids.tolist())
        out[2].extend(top_scores.tolist())
    return out


def top_k(
    vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank int, vec_id, score)``: the ``k`` highest integer inner products.

    ``is_query`` tells queries by the column ``id``; every query is held against every row
    with another identifier and the same dimension. Ties go to the smaller identifier. Vectors
    that are null, or hold null or non-finite components, take no part; scores must fit a long.
    Queries and candidates meet in blocks of bounded size.
    """
    points = cut_lineage(quantised(vectors, id_col, vector_col, scale))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = {
        dim: np.array([np.frombuffer(r["v"], "<i8") for r in chosen if r["dim"] == dim], dtype=np.float64)
        for dim in {r["dim"] for r in chosen}
    }
    table = cut_lineage(pivot_table(points, pivots))
    queries = table.where(is_query(F.col("id")))
    n_groups = max(1, -(-table.count() // CANDIDATE_BLOCK))
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    candidates = table.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int").alias("part"), "dim", "id", "v", "near",
    )
    asked = queries.select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("part"), "dim", "id", "v", "near",
    )

    def unpack(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = side.num_rows
        v = np.frombuffer(b"".join(side["v"].to_pylist()), "<i8").reshape(n, -1)
        near = np.frombuffer(b"".join(side["near"].to_pylist()), "<f4").astype(np.float64).reshape(n, -1)
        return side["id"].to_numpy(), v, near

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            found = best_of(*unpack(left), *unpack(right), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    keys = ("block", "part", "dim")
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score long"
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
