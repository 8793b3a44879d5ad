"""Exact vector search and the embedding cache.

Queries and vectors meet in blocks: both are dealt into parts of bounded size by hash, and a
task compares one part of either with matrix products. Nothing passes through the driver, the
vectors are scanned once, and a task hands on only its own best candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import top_k
from tidegate.session import cut_lineage

#: Rows of a part, on average: 2,048 x 64 doubles are 1 MB.
PART_ROWS = 2_048

#: Scores of every query (rows) with every vector (columns).
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays in double precision; null for unequal or zero vectors."""
    product = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda total, x: total + x,
    )
    scale = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (scale > 0), product / scale)


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def vector_faults(vectors: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """Rows that cannot be scored, with the reason."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    fault = (
        F.when(F.col(vector).isNull() | (F.size(vector) == 0), "embedding vectors must not be empty")
        .when(F.size(vector) != dimensions, "embedding vectors must have matching dimensions")
        .when(bad, "embedding vectors must be finite")
        .when(norm(F.col(vector)) == 0, "embedding vectors must not be zero")
    )
    return vectors.withColumn("fault", fault)


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key; only (key, dimension) sums are shuffled."""
    parts = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    means = parts.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_cells")
    ).select(key, F.transform("_cells", lambda cell: cell["x"]).alias("query"))


def cosine_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The default scorer; zero vectors score nan."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        return unit(queries) @ unit(vectors).T


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)


def in_parts(queries: DataFrame, vectors: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``compare`` on every part of ``queries`` (id, x) with every part of ``vectors`` (id, x).

    Both sides are written first: a row's part follows from its place in the written files, so it is
    the same when a lost executor's rows are dealt again.
    """
    asked, held = cut_lineage(queries), cut_lineage(vectors)
    blocks, parts = (max(1, -(-rows.count() // PART_ROWS)) for rows in (asked, held))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda rows, n: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = asked.select(own(asked, blocks).alias("block"), "id", "x").select("block", every(parts).alias("part"), "id", "x")
    right = held.select(own(held, parts).alias("part"), "id", "x").select(every(blocks).alias("block"), "part", "id", "x")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compare, ddl)


def topk_vector(
    vectors: DataFrame, queries: DataFrame, k: int, *,
    id_column: str = "vec_id", vector: str = "embedding",
    query_id: str = "query_id", query_vector: str = "query", scorer: Scorer = cosine_scores,
) -> DataFrame:
    """Exact ``k`` nearest vectors per query by ``scorer``, ties by id."""

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: tuple = ([], [], [])
        if asked.num_rows and held.num_rows:
            scores, names = scorer(matrix(asked["x"]), matrix(held["x"])), held["id"].to_numpy()
            for query, row in zip(asked["id"].to_pylist(), scores):
                order = np.lexsort((names, -np.round(row, 9)))[:k]
                for column, values in zip(out, ([query] * len(order), names[order].tolist(), row[order].tolist())):
                    column.extend(values)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), id_column: pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = in_parts(
        queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).alias("x")),
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("x")),
        best, f"query_id BIGINT, {id_column} BIGINT, score DOUBLE",
    )
    order = [F.desc(F.round("score", 9)), F.asc(id_column)]
    return top_k(found, ["query_id"], order, k)


def best_chunk_scores(
    chunks: DataFrame, queries: DataFrame, *, doc: str, vector: str = "embedding",
    query_id: str = "query_id", query_vector: str = "query", scorer: Scorer = cosine_scores,
) -> DataFrame:
    """Best chunk similarity per query and document; maxima combine before the shuffle."""

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: tuple = ([], [], [])
        if asked.num_rows and held.num_rows:
            scores = scorer(matrix(asked["x"]), matrix(held["x"]))
            names, place = np.unique(held["id"].to_numpy(), return_inverse=True)
            top = np.full((len(scores), len(names)), -np.inf)
            for row, values in zip(top, scores):
                np.maximum.at(row, place, values)
            out = (np.repeat(asked["id"].to_numpy(), len(names)), np.tile(names, len(scores)), top.ravel())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = in_parts(
        queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).alias("x")),
        chunks.select(F.col(doc).cast("long").alias("id"), F.col(vector).alias("x")),
        best, "query_id BIGINT, doc_id BIGINT, score DOUBLE",
    )
    return found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


# -- embedding cache ---------------------------------------------------------------------


def cache_key(content: Column, model: str, version: str, dimensions: int) -> Column:
    """Content address of an embedding."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(version), F.lit(str(dimensions)), content), 256)


def word_codes(content: Column) -> Column:
    """CRC-32 of every word; a text without words has the code of the empty one."""
    words = F.filter(F.split(content, r"(?U)\s+"), lambda word: word != "")
    return F.transform(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(""))), F.crc32)


def hashing_embedder(dimensions: int) -> Callable[[Column], Column]:
    """Deterministic default embedder: signed word hashing, unit length.

    Words are cut and hashed by Spark; a batch of code lists becomes vectors in numpy.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            lengths = batch.map(len).to_numpy()
            codes = np.concatenate(batch.to_numpy()) if len(batch) else np.empty(0, dtype=np.int64)
            rows = np.repeat(np.arange(len(batch)), lengths)
            sums = np.zeros((len(batch), dimensions))
            np.add.at(sums, (rows, codes % dimensions), np.where(codes & 0x80000000, 1.0, -1.0))
            scale = np.linalg.norm(sums, axis=1)
            sums[scale == 0.0, 0] = 1.0
            scale[scale == 0.0] = 1.0
            yield pd.Series(list((sums / scale[:, None]).astype("float32")))

    # Type hints of a pandas UDF must be real objects, not strings.
    embed.__annotations__ = {
        "batches": Iterator[pd.Series], "return": Iterator[pd.Series],
    }
    vectors = F.pandas_udf(embed, "array<float>")
    return lambda content: vectors(word_codes(content))


#: Texts that one call of an embedder takes.
CALL_TEXTS = 64
WRONG_COUNT = "embedder returned a vector count different from its inputs"


def calling_embedder(call: Callable[[list[str]], list], most: int = CALL_TEXTS) -> Callable[[Column], Column]:
    """An embedder that asks ``call`` for the vectors of at most ``most`` texts at a time.

    Calls follow one another within a task; one that answers with another number of vectors fails
    the job instead of shifting vectors to other texts. A null text is an empty one.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, out = batch.fillna("").tolist(), []
            for at in range(0, len(texts), most):
                asked = texts[at : at + most]
                answer = call(asked)
                if len(answer) != len(asked):
                    raise ValueError(WRONG_COUNT)
                out += [np.asarray(vector, dtype="float32") for vector in answer]
            yield pd.Series(out, dtype=object)

    # Type hints of a pandas UDF must be real objects, not strings.
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, "array<float>")


def cache_misses(docs: DataFrame, cached: DataFrame, content: str, model: str, version: str,
                 dimensions: int) -> DataFrame:
    """Distinct texts without a cached vector, each with its key."""
    keyed = docs.select(
        cache_key(F.col(content), model, version, dimensions).alias("key"), F.col(content).alias("content")
    )
    # Equal keys mean equal text: any copy will do, and copies combine before the shuffle.
    return keyed.groupBy("key").agg(F.any_value("content").alias("content")).join(
        cached.select("key"), "key", "left_anti"
    )


def embed_misses(misses: DataFrame, dimensions: int, embedder=None) -> DataFrame:
    """Vectors for the misses through a batch embedder."""
    run = embedder or hashing_embedder(dimensions)
    return misses.select("key", run(F.col("content")).alias("vector"))
