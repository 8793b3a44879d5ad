"""Operator 12: embedding whitening by Jacobi-Davidson.

The covariance is never formed: Spark applies it to a few vectors at once, by products of centred
rows that are added up across tasks. The driver holds what has the length of one embedding times
the size of the search space. Corrections come from the projected equations, solved by a few
steps of MINRES; a Rayleigh-Ritz step gives new pairs, and those with a residual at rounding
level are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import schema_of
from tidegate.llm.whole_vectors import matrix, whole_vectors
from tidegate.session import cut_lineage

#: Rows of a product at once in a task.
BLOCK = 4096
#: A pair is locked when its residual is at most this share of the largest eigenvalue.
TOLERANCE = 2.0**-44
#: Pairs corrected at once beyond those asked for, steps of the inner solver, and the largest
#: search space as a multiple of the pairs corrected at once.
GUARD_PAIRS, INNER_STEPS, SPACE_FACTOR = 4, 4, 8
#: Outer steps after which the search gives up with an error.
MOST_STEPS = 200
#: Eigenvalues up to this share of the largest one count as zero.
NO_VARIANCE = 1e-12


def column_sums(df: DataFrame, size: int, partial: Callable[[np.ndarray], np.ndarray], width: int, start: int | float) -> list:
    """Sum of ``partial(block of x)`` (``size`` numbers) over all blocks of all tasks.

    A task sends ``size`` rows, which combine before the shuffle; the driver gets ``size`` rows.
    With an integer ``start`` sums are exact.
    """
    exact = isinstance(start, int)
    kind = "decimal(38,0)" if exact else "double"
    schema = schema_of(f"i int, v {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.full(size, start, dtype=object if exact else np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total = total + partial(matrix(batch.column(0).slice(at, BLOCK), width))
        values = pa.array([int(t) for t in total], schema.field(1).type) if exact else pa.array(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), values], schema=schema)

    rows = df.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = [start] * size
    for r in rows:
        out[r["i"]] = int(r["v"]) if exact else r["v"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows minus the mean as doubles; the difference is taken of whole numbers where they fit."""
    return np.asarray(multiples(x, n, sums), dtype=np.float64) / n


def multiples(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: longs where they fit, else Python's integers."""
    largest = max((abs(int(m)) for m in (x.max(initial=0), x.min(initial=0))), default=0)
    if n * largest + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def orthonormal(new: np.ndarray, space: np.ndarray) -> np.ndarray:
    """``new`` made orthonormal against ``space`` and within; columns without a new direction go."""
    out = space
    first = space.shape[1]
    for column in new.T:
        before = np.linalg.norm(column)
        for _ in range(3):  # twice is enough, and the third time settles tiny columns
            column = column - out @ (out.T @ column)
            after = np.linalg.norm(column)
            if after <= 1e-10 * before or after == 0:
                break
            column = column / after
            before = 1.0
        else:
            out = np.column_stack([out, column])
    return out[:, first:]


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for several symmetric systems in step; ``apply`` gets one vector of each.

    ``right`` has a system's right side in each column. A system whose Krylov space is exhausted
    keeps its solution.
    """
    beta = np.linalg.norm(right, axis=0)
    scale = np.where(beta > 0, beta, 1.0)
    v, v_old = right / scale, np.zeros_like(right)
    solution, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, c, c_old = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    s, s_old, b = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        image = apply(v)
        alpha = (v * image).sum(axis=0)
        image = image - alpha * v - b * v_old
        b_new = np.linalg.norm(image, axis=0)
        delta = c * alpha - c_old * s * b
        rho2 = s * alpha + c_old * c * b
        rho3 = s_old * b
        rho1 = np.hypot(delta, b_new)
        live = live & (rho1 > 0)
        safe = np.where(live, rho1, 1.0)
        c_old, s_old = c, s
        c, s = delta / safe, b_new / safe
        w, w_old = (v - rho3 * w_old - rho2 * w) / safe, w
        solution = solution + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live = live & (b_new > 1e-14 * np.abs(alpha))
        v_old, v = v, image / np.where(b_new > 0, b_new, 1.0)
        b = b_new
    return solution


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors (columns) of a positive semidefinite operator.

    ``product`` applies the operator to the columns of a matrix; it is all that is known of it.
    Several pairs are corrected in step, so an inner step of all of them is one product.
    """
    pairs = min(pairs, width)
    block = min(width, pairs + GUARD_PAIRS)
    most = min(width, block * SPACE_FACTOR)
    draw = np.random.default_rng(12)
    space = orthonormal(draw.normal(size=(width, block)), np.zeros((width, 0)))
    image = product(space)
    for _ in range(MOST_STEPS):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = space @ turn, image @ turn
        ahead = min(block, vectors.shape[1])
        residuals = images[:, :ahead] - vectors[:, :ahead] * values[:ahead]
        sizes = np.linalg.norm(residuals, axis=0)
        done = sizes <= TOLERANCE * max(values[0], 0.0)
        # locked: the leading pairs at rounding level; they stay in the space and leave the corrections
        locked = int(np.argmin(done[:pairs])) if not done[:pairs].all() else pairs
        if locked == pairs:
            return values[:pairs], vectors[:, :pairs]
        if space.shape[1] + block > most and space.shape[1] < width:
            keep = min(space.shape[1], max(block, most // 2))
            space, image = vectors[:, :keep], images[:, :keep]
        open_ = [i for i in range(locked, ahead) if not done[i]]
        theta, own = values[open_], vectors[:, open_]
        fixed = vectors[:, :locked]

        def project(t: np.ndarray) -> np.ndarray:
            t = t - fixed @ (fixed.T @ t)
            return t - own * (own * t).sum(axis=0)

        def shifted(t: np.ndarray) -> np.ndarray:
            t = project(t)
            return project(product(t) - t * theta)  # noqa: B023

        fresh = orthonormal(minres(shifted, -project(residuals[:, open_]), INNER_STEPS), space)
        if not fresh.shape[1]:
            fresh = orthonormal(draw.normal(size=(width, block)), space)
        if not fresh.shape[1]:  # the space is whole: a product of the Ritz vectors themselves is all that can be better
            if (sizes[:pairs] <= 2**6 * TOLERANCE * max(values[0], 0.0)).all():
                return values[:pairs], vectors[:, :pairs]
            space, image = vectors, product(vectors)
            continue
        space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh)])
    raise ArithmeticError(f"residuals {sizes[:pairs]} after {MOST_STEPS} steps")


def whiten(
    df: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(id_col, component int, n long, deviation decimal, whitened, explained, identity_error double)``.

    One row for each kept vector and component, numbered by falling eigenvalue of the covariance
    of the distinct whole-number vectors. Vectors that are null or hold null or non-finite entries
    are dropped; shorter ones are padded with zeros to the longest length. Repeated rows and null
    identifiers stay, and count once in the fit. With fewer dimensions than ``components`` there
    are as many components as dimensions. A component without variance has a null ``whitened``
    and takes no part in ``identity_error``, which is null if none has any; ``explained`` is null
    if the trace is 0. Equal eigenvalues leave the basis of their space open. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    vectors, width = whole_vectors(df, scale, id_col, vector_col)
    fit_list = cut_lineage(vectors.select("x").distinct())
    n = fit_list.count()
    pairs = min(components, width)
    sums = column_sums(fit_list, width, lambda x: x.astype(object).sum(axis=0), width, 0) if n and width else []

    def product(v: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return (c.T @ (c @ v)).ravel()

        return np.array(column_sums(fit_list, v.size, partial, width, 0.0)).reshape(v.shape) / n

    def squares(x: np.ndarray) -> np.ndarray:
        return np.array([(centred(x, n, sums) ** 2).sum()])

    trace = column_sums(fit_list, 1, squares, width, 0.0)[0] / n if n and width else 0.0
    if trace > 0:
        values, basis = jacobi_davidson(product, width, pairs)
    else:
        values, basis = np.zeros(pairs), np.eye(width, pairs)
    varied = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    scaled = basis / np.sqrt(np.where(varied, values, 1.0))
    error = identity_error(fit_list, width, n, sums, scaled[:, varied]) if varied.any() else None

    key = df.schema[id_col].dataType.simpleString()
    ddl = f"id {key}, component int, deviation decimal(38,0), whitened double, explained double"
    schema = schema_of(ddl)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x = matrix(block.column(1), width)
                whole = multiples(x, n, sums)
                if whole.dtype != object and width * float(np.abs(whole).max(initial=0)) ** 2 >= 2.0**62:
                    whole = whole.astype(object)
                deviation = pa.array([int(t) for t in (whole * whole).sum(axis=1)], schema.field(2).type)
                z = centred(x, n, sums) @ scaled
                for k in range(pairs):
                    yield pa.RecordBatch.from_arrays([
                        block.column(0).cast(schema.field(0).type), pa.array(np.full(len(x), k + 1, dtype=np.int32)), deviation,
                        pa.array(z[:, k], mask=np.full(len(x), not varied[k])),
                        pa.array(np.full(len(x), values[k] / trace if trace > 0 else 0.0), mask=np.full(len(x), trace <= 0)),
                    ], schema=schema)

    return vectors.select("id", "x").mapInArrow(project, ddl).select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(fit_list: DataFrame, width: int, n: int, sums: list[int], scaled: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = scaled.shape[1]

    def partial(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ scaled
        return (z.T @ z).ravel()

    second = np.array(column_sums(fit_list, k * k, partial, width, 0.0)).reshape(k, k) / n
    return float(np.abs(second - np.eye(k)).max())
