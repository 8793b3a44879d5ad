"""Stateless and windowed streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.metrics import LOW_SAMPLE, share
from tidegate.sources.sinks import audit_rows
from tidegate.streaming.ordered import InOrder, in_order


def idempotent_create(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each key; repeats are no-ops. Keys are kept for good."""
    return events.dropDuplicates(keys)


#: Size of the quantile sketches; ranks are exact up to as many rows of a window and decision, and
#: off by 1.33 % of them beyond (at 99 % confidence).
SKETCH_SIZE = 200


def windowed_metrics(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """Decision metrics per tumbling window, emitted once the watermark has passed it.

    Durations are kept as a mergeable sketch in the window's state, so its size does not grow
    with the rows; the median and the 95th percentile are read from it at emission.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rolled = timed.groupBy(F.window("ts", width), "decision").agg(
        F.count("*").alias("n"),
        F.count_if("unknown").alias("unknowns"),
        F.sum("shadow_findings").alias("shadow_hit_count"),
        F.sum("duration_ms").alias("duration_ms_total"),
        F.max("duration_ms").alias("duration_ms_max"),
        F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(SKETCH_SIZE)).alias("sketch"),
    )

    def quantile(share: float, name: str):
        some = F.kll_sketch_get_n_double("sketch") > 0
        return F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(share))).alias(name)

    return rolled.select(
        F.col("window.start").alias("window_start"), "decision", "n", "unknowns", "shadow_hit_count",
        "duration_ms_total", "duration_ms_max", quantile(0.5, "duration_ms_p50"), quantile(0.95, "duration_ms_p95"),
        share(F.col("unknowns"), F.col("n")).alias("unknown_rate"), (F.col("n") < LOW_SAMPLE).alias("low_sample"))


class TtlCache(InOrder):
    """Marks each use of a key as a hit within the TTL of its last fill; a timer forgets the fill."""

    columns = ("event_id", "hit")

    def __init__(self, ttl_seconds: float) -> None:
        self.ttl = round(ttl_seconds * 1_000_000)

    def step(self, record: dict, at: int, seq: int, payload: dict) -> tuple[dict, tuple]:
        hit = "filled" in record
        return record if hit else {"filled": at}, (seq, hit)

    def late(self, record: dict, at: int, seq: int, payload: dict) -> tuple:
        return seq, None

    def wakes(self, record: dict) -> list[int]:
        # a use at the very end of the TTL is a hit
        return [record["filled"] + self.ttl + 1] if "filled" in record else []

    def wake(self, record: dict, at: int) -> tuple[dict, tuple | None]:
        return {}, None


def ttl_cache(events: DataFrame, key: str, ttl_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """``(key, event_id, hit)`` for every use in the order of ``ts``; a use that comes late has a null ``hit``."""
    return in_order(events, key, "ts", "event_id", F.struct("event_id"), lateness, TtlCache(ttl_seconds), "event_id BIGINT, hit BOOLEAN")


def late_revisions(events: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """Stream-static join with the pinned revision; other revisions are marked INDEX_LAG."""
    pinned = pins.select(key, F.col("revision").alias("pinned_revision"))
    return events.join(pinned, key, "left").withColumn(
        "status",
        F.when(F.col("revision") == F.col("pinned_revision"), "OK").otherwise("INDEX_LAG"),
    )


def redacted_audit(events: DataFrame) -> DataFrame:
    return audit_rows(events)
