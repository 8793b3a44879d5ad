"""Sinks: snapshots, immutable inserts, upserts, audit trails and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.safety import redact_map
from tidegate.operators.ordered import latest
from tidegate.session import parts_of


def write_snapshot(edges: DataFrame, path: str) -> None:
    """Append a snapshot below its revision folder; a task sorts what it writes by revision, so parts stay small."""
    edges.repartition(parts_of(edges), *edges.columns).write.mode("append").partitionBy("revision").parquet(path)


def put_if_absent(stored: DataFrame, incoming: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and conflicts: the same id may only come with the same payload.

    Copies inside one load are reduced by (id, payload) first, so a repeated id is one row
    per distinct payload however often it is sent.
    """
    distinct = incoming.groupBy(key, payload).agg(F.count("*").alias("sent"))
    versions = distinct.groupBy(key).agg(
        F.min(payload).alias("_first"), F.max(payload).alias("_last")
    )
    old = stored.select(key, F.col(payload).alias("_stored"))
    joined = distinct.join(versions, key).join(old, key, "left")
    clash = F.coalesce(
        F.col("_stored") != F.col(payload), F.col("_first") != F.col("_last")
    )
    inserts = joined.where(F.col("_stored").isNull() & (F.col("_first") == F.col("_last")))
    return inserts.select(key, payload), joined.where(clash).select(key, payload)


def upsert_latest(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both sides with the newest row per key."""
    columns = [c for c in stored.columns if c not in keys]
    return latest(stored.unionByName(incoming), keys, order, columns)


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows with redacted details."""
    return events.withColumn("details", redact_map(F.col("details")))


def append_audit(events: DataFrame, path: str) -> None:
    audit_rows(events).write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write an aggregated report as one JSON file; for results of a few rows only."""
    report.coalesce(1).write.mode("overwrite").json(path)
