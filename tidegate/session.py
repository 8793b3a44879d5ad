"""Session helpers: lineage cuts and shared scratch folders.

Intermediate results go to the reliable checkpoint folder, never to executor-local
storage, so losing an executor costs a re-read and not a failed job.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from threading import local

from pyspark.sql import DataFrame, SparkSession

#: Run folders that this driver made and will remove.
_OWNED: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only in local mode."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="tidegate-checkpoint-")
        context.setCheckpointDir(configured)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def run_root(spark: SparkSession) -> str:
    """The folder of this application below the shared one; the driver that made it removes it at its end."""
    root = f"{checkpoint_root(spark).rstrip('/')}/run-{spark.sparkContext.applicationId}"
    if root not in _OWNED:
        _OWNED.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    """Delete a folder through its file system, if the session still answers."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """Return a fresh folder path in the run folder; it goes with the ``passing`` block that it is made in."""
    path = f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in getattr(_BLOCKS, "open", [])[-1:]:
        made.append(path)
    return path


#: Folders made in the open ``passing`` blocks of a thread.
_BLOCKS = local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch folders made inside at the end of the block.

    What is read after it must be written by then, into a folder that ``scratch_dir`` gave before the block.
    """
    _BLOCKS.open = [*getattr(_BLOCKS, "open", []), []]
    try:
        yield
    finally:
        *_BLOCKS.open, made = _BLOCKS.open
        for path in made:
            _remove(spark, path)


#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files: nothing reads them again once the result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with suppress(Exception):  # the session may have ended
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    The plan stays short in iterative jobs, a lost executor only re-reads files, and the
    table has true sizes, so later joins pick their strategy from facts. ``codec`` packs whole texts closer
    than the session's own, for more time.
    """
    folder = folder or scratch_dir(df.sparkSession, "cut")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_levels(df: DataFrame, folders: list[str]) -> DataFrame:
    """All written levels of an iterative job as one scan."""
    return df.sparkSession.read.schema(df.schema).parquet(*folders)


#: Rows that a part holds on average where tasks sort or group them.
PART_ROWS = 1 << 19


def parts_of(rows: DataFrame, each: int | None = None) -> int:
    """How many parts ``rows`` ask for, by their number: rows of like strings are many in few shuffled bytes.

    Never fewer than the session's shuffle partitions; given to ``repartition``, the number stays.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (each or PART_ROWS) + 1)
