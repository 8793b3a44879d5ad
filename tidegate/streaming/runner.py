"""Run a stream over everything that is available and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(
    spark: SparkSession, folder: str, name: str, trigger_bytes: int = 1 << 30, trigger_files: int | None = None
) -> DataFrame:
    """Stream one parquet table; its schema is read from the files, never guessed.

    ``trigger_bytes`` bounds a micro-batch and with it the rows one key can bring at once;
    ``trigger_files`` bounds its files instead.
    """
    table = f"{folder}/{name}.parquet"
    bound = ("maxBytesPerTrigger", trigger_bytes) if trigger_files is None else ("maxFilesPerTrigger", trigger_files)
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option(bound[0], str(bound[1]))
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(table)
    # a stream reads folders: that of a table of one file, and of its files this one
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class Clock:
    """Closing marks: rows that carry nothing but time and move the watermark of the stream beside them.

    A drained stream holds back what the watermark has not passed. A mark after its last row says
    that nothing earlier will come.
    """

    def __init__(self, spark: SparkSession, column: str = "ts", kind: str = "timestamp_ntz") -> None:
        self.spark, self.column, self.kind = spark, column, kind
        self.folder = scratch_dir(spark, "clock")
        spark.createDataFrame([], f"{column} {kind}").write.parquet(self.folder)

    def beside(self, stream: DataFrame) -> DataFrame:
        """``stream`` with the marks as further rows; all its other columns are null in them."""
        marks = self.spark.readStream.schema(f"{self.column} {self.kind}").parquet(self.folder)
        return stream.unionByName(marks, allowMissingColumns=True)

    def mark(self, after: DataFrame, lateness: str) -> None:
        """Say that time has passed the latest row of the batch table ``after`` by ``lateness``."""
        moment = F.expr(f"max({self.column}) + INTERVAL {lateness} + INTERVAL 2 MILLISECONDS")
        after.agg(moment.cast(self.kind).alias(self.column)).write.mode("append").parquet(self.folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", then=None) -> DataFrame:
    """Drain a stream into parquet below the shared folder, exactly once per row.

    ``then`` is called when it is drained, and what that brought is drained, too.
    """
    spark = stream.sparkSession
    folder, log = scratch_dir(spark, name), scratch_dir(spark, f"{name}-log")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for follow in (None, then) if then else (None,):
        if follow:
            follow()
        job = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", folder)
            .option("checkpointLocation", log)
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def run_batches(stream: DataFrame, name: str, write, then=None) -> None:
    """Drain a stream through ``write(batch, id)``; ``then`` as in ``run_to_table``."""
    log = scratch_dir(stream.sparkSession, f"{name}-log")
    for follow in (None, then) if then else (None,):
        if follow:
            follow()
        job = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", log)
            .trigger(availableNow=True)
            .start()
        )
        job.awaitTermination()
