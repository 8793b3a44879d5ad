"""Run a function over blocks of rows inside tasks, with bounded blocks in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed to a function at once; what it holds is this many texts and their results.
BLOCK_ROWS = 256


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def map_blocks(
    df: DataFrame, ddl: str, make: Callable[[], Callable[..., dict]], rows: int = BLOCK_ROWS
) -> DataFrame:
    """Apply ``make()(*columns as Python lists)``, a dict of output columns, to blocks of ``df``.

    ``make`` runs once in each task, so it can load what the rows share. An output may have
    another number of rows than its block.
    """
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(column.to_pylist() for column in part.columns))
                arrays = [_array(out[f.name], f.type) for f in schema]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.mapInArrow(run, ddl)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Columns as arrays for each run of rows with equal values in the first ``keys`` integer columns.

    The rows must come sorted by those columns; a run may span batches.
    """
    import numpy as np

    held: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for column in columns[:keys]:
            changed[1:] |= column[1:] != column[:-1]
        changed[0] = not held or any(held[-1][k][-1] != columns[k][0] for k in range(keys))
        starts = np.flatnonzero(changed).tolist()
        if held and (not starts or starts[0] > 0):
            held.append([c[: starts[0] if starts else None] for c in columns])
        if not starts:
            continue
        if held:
            yield [np.concatenate(parts) for parts in zip(*held)]
        for a, b in zip(starts, starts[1:]):
            yield [c[a:b] for c in columns]
        held = [[c[starts[-1] :] for c in columns]]
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]
