"""Keyed state that sees its rows in event-time order, however micro-batches deal them.

Keys are dealt into buckets. Rows wait in their bucket's state until the watermark has passed them;
one event-time timer a bucket wakes it, and what is due is folded key by key in the order of time
and sequence number. A subclass may ask to be woken between rows, too. So the outcome depends on
the rows alone, and a row that comes after its turn is handed out as late instead of being folded
out of order.

A call into Python and its state costs milliseconds, a folded row microseconds: many small keys
share the calls of their bucket, and each keeps its own record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def timer_of(micros: int) -> int:
    """The first whole millisecond after a moment."""
    return micros // 1000 + 1


#: Buckets that keys are dealt into; a bucket's waiting rows are in one task's memory when it wakes.
BUCKETS = 1024
#: Rows of one entry of the waiting list.
CHUNK = 10_000


class InOrder(StatefulProcessor):
    """Fold rows ``(at, seq, payload)`` of a key in order; rows with an equal place count once.

    Waiting rows are those of a bucket within the lateness of the watermark, in chunks. ``records``
    holds a record a key, ``alarms`` the next moment that each key of the bucket asks for.
    """

    #: Names of the columns that ``step``, ``wake`` and ``late`` give after the key.
    columns: tuple[str, ...]

    def begin(self) -> dict:
        """The record of a key nobody has seen."""
        return {}

    def step(self, record: dict, at: int, seq: int, payload: dict) -> tuple[dict, tuple]:
        """The record after a row, and the output row."""
        raise NotImplementedError

    def late(self, record: dict, at: int, seq: int, payload: dict) -> tuple:
        """The output row of a row that came after its turn."""
        raise NotImplementedError

    def wakes(self, record: dict) -> list[int]:
        """Moments (microseconds) at which ``wake`` has to run."""
        return []

    def wake(self, record: dict, at: int) -> tuple[dict, tuple | None]:
        """The record at a moment asked for, which it must ask for no longer, and an output row or none."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "key STRING", "payload STRING")
        self.waiting = handle.getListState("waiting", "rows STRING")
        self.alarms = handle.getValueState("alarms", "moments STRING")
        self.timer = handle.getValueState("timer", "at BIGINT")

    def _record(self, key: str) -> dict | None:
        held = self.records.getValue((key,))
        return json.loads(held[0]) if held else None

    def _wake_at(self, moment: int | None, held: int | None) -> None:
        """Have one timer, for the first of the moments waited for."""
        wanted = None if moment is None else timer_of(moment)
        if wanted == held:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if wanted is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", *self.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        first, kept, late = None, [], {}
        for frame in rows:
            for name, at, seq, payload in zip(frame["key"], frame["at"], frame["seq"], frame["payload"]):
                # closing marks carry time and no payload
                if payload is None or pd.isna(seq):
                    continue
                if at < passed:
                    late.setdefault(name, []).append((int(at), int(seq), payload))
                    continue
                first = int(at) if first is None else min(first, int(at))
                kept.append((name, int(at), int(seq), payload))
                if len(kept) == CHUNK:
                    self.waiting.appendValue((json.dumps(kept),))
                    kept = []
        if kept:
            self.waiting.appendValue((json.dumps(kept),))
        if first is not None:
            held = self.timer.get() if self.timer.exists() else None
            if held is None or timer_of(first) < held[0]:
                self._wake_at(first, held[0] if held else None)
        out = []
        for name, those in late.items():
            record = self._record(name) or self.begin()
            out += [(name, *self.late(record, at, seq, json.loads(p))) for at, seq, p in sorted(those)]
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = {}, []
        for (chunk,) in self.waiting.get() if self.waiting.exists() else ():
            for name, at, seq, payload in json.loads(chunk):
                if at < passed:
                    due.setdefault(name, {})[at, seq] = payload
                else:
                    rest.append((name, at, seq, payload))
        alarms = json.loads(self.alarms.get()[0]) if self.alarms.exists() else {}
        woken = {name for name, moment in alarms.items() if moment < passed}
        changed, out = False, []
        for name in sorted(woken.union(due)):
            held = self._record(name)
            own, later = self._fold(self.begin() if held is None else held, due.get(name, {}), passed, name, out)
            if own == self.begin():
                if held is not None:
                    self.records.removeKey((name,))
            elif own != held:
                self.records.updateValue((name,), (json.dumps(own),))
            if later != alarms.pop(name, None):
                changed = True
            if later is not None:
                alarms[name] = later
        if due:
            chunks = [(json.dumps(rest[n:n + CHUNK]),) for n in range(0, len(rest), CHUNK)]
            self.waiting.put(chunks) if chunks else self.waiting.clear()
        if changed:
            self.alarms.update((json.dumps(alarms),)) if alarms else self.alarms.clear()
        moments = [row[1] for row in rest] + list(alarms.values())
        # the timer that fired is gone
        self.timer.clear()
        self._wake_at(min(moments, default=None), None)
        yield from self._frame(out)

    def _fold(self, own: dict, due: dict, passed: int, name: str, out: list[tuple]) -> tuple[dict, int | None]:
        """The record after all that is due, and the next moment it asks for; output rows go to ``out``."""
        for place in [*sorted(due), None]:
            while (moment := min(self.wakes(own), default=passed)) < (place[0] + 1 if place else passed):
                own, row = self.wake(own, moment)
                out += [(name, *row)] if row else []
            if place:
                own, row = self.step(own, *place, json.loads(due[place]))
                out.append((name, *row))
        return own, min(self.wakes(own), default=None)

    def close(self) -> None:
        pass


def in_order(
    events: DataFrame, key: str, time: str, seq: str, payload: Column, lateness: str,
    processor: InOrder, output: str,
) -> DataFrame:
    """Run ``processor`` over a stream; ``output`` is the DDL of the key and the processor's columns.

    The event time goes on as a plain number, so that Spark does not drop late rows unseen.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = timed.select(
        F.pmod(F.xxhash64(name), F.lit(BUCKETS)).alias("_bucket"), name.alias("key"), F.unix_micros(time).alias("at"),
        F.col(seq).cast("bigint").alias("seq"),
        F.when(F.col(key).isNotNull(), F.to_json(payload)).alias("payload"),
    )
    return placed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"key STRING, {output}", outputMode="Append", timeMode="EventTime",
    ).withColumnRenamed("key", key)
