"""Operator 13: vector code compression with exact integer distances.

Vectors are cut into parts and every part becomes the index of the nearest entry of its
codebook. Parts and entries are padded with zeros to a power of two and go through an integer
Walsh-Hadamard transform, which multiplies every squared distance by the padded length. Squared
differences are added up in sequency order: most of a distance lies in the first terms, so most
entries are out of the race early. Nothing is a floating-point number, so ties are ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.arrow import schema_of
from tidegate.llm.whole_vectors import matrix, whole_vectors
from tidegate.session import cut_lineage

#: Rows whose distances a task holds at once (times the entries of one codebook).
BLOCK = 1024
#: Terms added to all entries before the first elimination, and between two further ones.
FIRST_TERMS, STEP_TERMS = 4, 2
#: Share of entries still in the race below which they are handled as a list of (row, entry).
#: Above it the eliminated ones only stay in the matrix as ballast: an addition costs less than a look-up.
LISTED_SHARE = 0.1
#: Up to this size of components, sums of squares of a part of 2**16 components fit a long.
SMALL = 1 << 21


def padded_length(width: int) -> int:
    """The least power of two that holds ``width`` components."""
    return 1 << max(0, width - 1).bit_length()


def sequency_order(length: int) -> np.ndarray:
    """Rows of the Hadamard matrix (natural order) by their number of sign changes."""
    bits = length.bit_length() - 1
    changes = np.arange(length)
    gray = changes ^ (changes >> 1)
    natural = np.zeros(length, dtype=np.int64)
    for bit in range(bits):
        natural |= ((gray >> bit) & 1) << (bits - 1 - bit)
    return natural


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, zero-padded, in sequency order; integers throughout."""
    length = padded_length(rows.shape[1])
    out = np.zeros((len(rows), length), dtype=rows.dtype)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < length:
        out = out.reshape(len(rows), -1, 2, half)
        out = np.stack([out[:, :, 0] + out[:, :, 1], out[:, :, 0] - out[:, :, 1]], axis=2).reshape(len(rows), length)
        half *= 2
    return out[:, sequency_order(length)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Index of the nearest entry of every row (ties to the lower), the squared distance, and the share of terms added.

    After the first terms of all entries the one ahead gives an upper bound, its whole distance.
    An entry whose sum so far exceeds the bound cannot win, since terms are squares.
    """
    spectrum, book = transform(rows), transform(entries)
    length = spectrum.shape[1]
    partial = np.zeros((len(rows), len(entries)), dtype=spectrum.dtype)

    def add(first: int, last: int) -> None:
        for j in range(first, last):
            gap = np.subtract.outer(spectrum[:, j], book[:, j])
            gap *= gap
            np.add(partial, gap, out=partial)

    at = min(FIRST_TERMS, length)
    add(0, at)
    ahead = book[partial.argmin(axis=1)]
    bound = ((spectrum - ahead) ** 2).sum(axis=1)
    racing = partial <= bound[:, None]
    while at < length and racing.mean() > LISTED_SHARE:
        last = min(length, at + STEP_TERMS)
        add(at, last)
        racing = partial <= bound[:, None]
        at = last
    terms = partial.size * at + ahead.size
    row, entry = np.nonzero(racing)
    total = partial[row, entry]
    while at < length:
        last = min(length, at + STEP_TERMS)
        gap = spectrum[row, at:last] - book[entry, at:last]
        total = total + (gap * gap).sum(axis=1)
        terms += gap.size
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
        at = last
    # rows are in ascending order and each keeps its bounding entry, so every row has a first place
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, starts)
    runs = np.diff(np.r_[starts, len(row)])
    position = np.where(total == np.repeat(least, runs), np.arange(len(row)), len(row))
    first = np.minimum.reduceat(position, starts)
    # the transform multiplied every squared distance by the padded length
    return entry[first], least // length, terms / max(1, partial.size * length)


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(rows, parts)`` and squared distances ``(rows, parts)``."""
    largest = max([np.abs(x).max(initial=0), *(np.abs(b).max(initial=0) for b in books)])
    if books[0].dtype == object or largest < 0 or largest >= SMALL:
        x = x.astype(object)  # Python's integers: slow and exact
        books = [b.astype(object) for b in books]
    width = books[0].shape[1]
    codes = np.zeros((len(x), len(books)), dtype=np.int64)
    gaps = np.zeros((len(x), len(books)), dtype=x.dtype)
    if width == 0:
        return codes, gaps
    for p, book in enumerate(books):
        codes[:, p], gaps[:, p], _ = nearest(x[:, p * width : (p + 1) * width], book)
    return codes, gaps


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            yield block, matrix(block.column(column), width)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def next_books(vectors: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign every part, then move entries to the floor of their parts' mean; unused entries stay.

    Tasks send a sum for each entry they used, which Spark adds up by entry; the driver gets one
    row for each entry.
    """
    parts, size = len(books), books[0].shape[1]
    ddl = "part int, entry int, n long, total array<decimal(38,0)>"
    schema = schema_of(ddl)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        for _, x in _blocks(batches, 0, width):
            x = _padded(x, parts * size)
            codes, _ = assign(x, books)
            small = np.abs(x).max(initial=0) < SMALL and x.min(initial=0) > -SMALL
            for p in range(parts):
                part = x[:, p * size : (p + 1) * size]
                own = np.zeros(books[p].shape, dtype=np.int64 if small else object)
                np.add.at(own, codes[:, p], part if small else part.astype(object))
                totals[p] = totals[p] + own
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
        used = [(p, int(e)) for p in range(parts) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays([
            pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
            pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
            pa.array([[int(t) for t in totals[p][e]] for p, e in used], schema.field(3).type),
        ], schema=schema)

    by_task = vectors.select("x").mapInArrow(sums, ddl)
    # one row for each component, so that sums of wide parts combine before the shuffle too
    by_entry = (
        by_task.select("part", "entry", "n", F.posexplode("total").alias("at", "value"))
        .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect()
    )
    moved = [b.copy() for b in books]
    for r in by_entry:
        mean = int(r["value"]) // r["n"]
        if abs(mean) >= SMALL and moved[r["part"]].dtype != object:
            moved = [b.astype(object) for b in moved]
        moved[r["part"]][r["entry"], r["at"]] = mean
    return moved


def learn(vectors: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks of ``whole_vectors``, one integer matrix for each part.

    They start as the parts of the vectors with the smallest identifiers (null ones last, then
    by components); with fewer vectors than ``entries`` each is an entry, repeated rows too.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    size = -(-width // parts)
    start = np.array([r["x"] + [0] * (parts * size - width) for r in first], dtype=object).reshape(len(first), parts * size)
    if all(abs(c) < SMALL for c in start.flat):
        start = start.astype(np.int64)
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    for _ in range(rounds if len(first) and size else 0):
        books = next_books(vectors, width, books)
    return books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.flat).encode()).hexdigest()


def compress(
    df: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(id_col, label_col, codes array<int>, error decimal, label_error decimal, codebooks_sha256)`` of every vector.

    Vectors that are null or hold null or non-finite components are dropped; shorter ones are
    padded with zeros to the longest length, and that to a multiple of ``parts``. Repeated rows
    and null identifiers stay, each with its own code. ``error`` is the squared distance to the
    entries of the code, ``label_error`` its sum over rows with an equal label, nulls together.
    An empty table gives no rows. Other columns are not read, whatever their names.
    """
    vectors, width = whole_vectors(df, scale, id_col, vector_col, (label_col,))
    books = learn(vectors, width, parts, entries, rounds)
    key, label = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    ddl = f"id {key}, e0 {label}, codes array<int>, error decimal(38,0)"
    schema, size = schema_of(ddl), books[0].shape[1]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _blocks(batches, 2, width):
            codes, gaps = assign(_padded(x, parts * size), books)
            flat = pa.array(codes.ravel().astype(np.int32))
            offsets = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                block.column(0).cast(schema.field(0).type), block.column(1).cast(schema.field(1).type),
                pa.ListArray.from_arrays(offsets, flat).cast(schema.field(2).type),
                pa.array([int(g) for g in gaps.sum(axis=1)], schema.field(3).type),
            ], schema=schema)

    coded = cut_lineage(vectors.select("id", "e0", "x").mapInArrow(code, ddl))
    # few rows, written, so Spark knows their size when it picks the join
    by_label = cut_lineage(coded.groupBy(F.col("e0").alias("other")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("e0").eqNullSafe(F.col("other"))).select(
        F.col("id").alias(id_col), F.col("e0").alias(label_col), "codes", "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
