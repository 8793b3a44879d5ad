"""Streams against folds over all rows: micro-batches of one file, in any order, must not matter."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidegate.operators import approvals as batch
from tidegate.streaming import approvals, jobs, runner

START = datetime(2024, 1, 1)
SEATS = ["owner0", "owner1", "owner2"]
DDL = "context_id STRING, seq BIGINT, ts TIMESTAMP_NTZ, action STRING, actor STRING, delegate STRING"


def at(minutes):
    return START + timedelta(minutes=minutes)


def in_files(spark, folder, ddl, parts, name="rows"):
    """One file for each part, in this order of time of change."""
    for n, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, ddl).coalesce(1)
        frame.write.mode("append").parquet(f"{folder}/{name}.parquet")
    return runner.table_stream(spark, str(folder), name, trigger_files=1)


def drain(spark, stream, build, last, lateness):
    clock = runner.Clock(spark)
    marks = spark.createDataFrame([(last,)], "ts TIMESTAMP_NTZ")
    return runner.run_to_table(build(clock.beside(stream)), "test", then=lambda: clock.mark(marks, lateness)).collect()


def actions(n, seed):
    rng = random.Random(seed)
    kinds = ["delegate", "request_evidence", "add_evidence", "approve", "reject"]
    rows = []
    for seq in range(n):
        actor = rng.randrange(4)
        rows.append((f"c{min(rng.randrange(20), 8)}", seq, at(seq), rng.choices(kinds, [2, 4, 4, 2, 1])[0], f"owner{actor}", f"owner{(actor + 1) % 4}"))
    return rows


def test_shuffled_files_give_the_states_of_the_batch_machine(spark, tmp_path):
    rows = actions(240, 3)
    shuffled = random.Random(1).sample(rows, len(rows))
    stream = in_files(spark, tmp_path, DDL, [shuffled[i::4] for i in range(4)])
    got = drain(spark, stream, lambda s: approvals.approval_states(s, SEATS, lateness="2 days"), at(240), "2 days")
    want = batch.batch_states(spark.createDataFrame(rows, DDL), SEATS).collect()
    assert sorted((r.context_id, r.seq, r.action, r.outcome, r.state) for r in got) == sorted(tuple(r) for r in want)


def test_late_rows_are_given_out_and_change_nothing(spark, tmp_path):
    rows = actions(90, 4)
    on_time, late = [r for r in rows if r[1] % 10], [r for r in rows if not r[1] % 10][:3]
    far = ("c0", 900, at(5000), "add_evidence", "owner0", "owner1")
    stream = in_files(spark, tmp_path, DDL, [on_time, [far], late])
    got = drain(spark, stream, lambda s: approvals.approval_states(s, SEATS, lateness="1 minute"), at(5000), "1 minute")
    by_seq = {r.seq: (r.outcome, r.state) for r in got}
    assert all(by_seq[r[1]][0] == approvals.LATE for r in late) and len(got) == len(on_time) + 1 + len(late)
    want = {r.seq: (r.outcome, r.state) for r in batch.batch_states(spark.createDataFrame([*on_time, far], DDL), SEATS).collect()}
    assert {s: by_seq[s] for s in want} == want


def test_deadlines_and_waivers_stand_in_the_order_of_time(spark, tmp_path):
    ddl = DDL + ", waiver_scope STRING, waiver_reason STRING, waiver_control STRING, waiver_until TIMESTAMP_NTZ"
    none = (None,) * 4
    rows = [
        ("open", 1, at(0), "request_evidence", "owner0", None, *none),
        ("open", 2, at(90), "approve", "owner1", None, *none),  # after the escalation, which admits it
        ("done", 3, at(0), "approve", "owner1", None, *none),
        ("waived", 4, at(10), "grant_waiver", "owner1", None, "s", "r", "c", at(30)),
        ("waived", 5, at(20), "grant_waiver", "owner1", None, "s", "r", "c", at(50)),  # replaces the first
        ("waived", 6, at(25), "grant_waiver", "owner1", None, "s", "", "c", at(50)),
        ("young", 7, at(100), "add_evidence", "owner1", None, *none),
        ("open", 2, at(90), "approve", "owner1", None, *none),  # once more
    ]
    stream = in_files(spark, tmp_path, ddl, [rows[i::3] for i in range(3)])
    got = drain(spark, stream, lambda s: approvals.approval_states(s, SEATS, 1, 3600 * 1000, "1 day"), at(100), "1 day")
    lines = {}
    for r in got:
        lines.setdefault(r.context_id, []).append((r.seq, r.action, r.outcome, r.state))
    assert sorted(lines["open"]) == sorted([
        (1, "request_evidence", "ok", "evidence_requested"), (-1, "escalate", "ok", "escalated"), (2, "approve", "ok", "approved")])
    assert lines["done"] == [(3, "approve", "ok", "approved")]
    assert lines["young"] == [(7, "add_evidence", "ok", "pending")]
    assert sorted(lines["waived"]) == sorted([
        (4, "grant_waiver", "ok", "pending"), (5, "grant_waiver", "ok", "pending"),
        (6, "grant_waiver", approvals.BAD_WAIVER, "pending"), (-1, "expire_waiver", "ok", "pending"),
        (-1, "escalate", "ok", "escalated")])


def test_cache_hits_do_not_depend_on_files(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(5), i, at(rng.randrange(3000))) for i in range(200)]
    rows.append((9, 900, at(10)))
    rows.append((9, 901, at(70)))  # at the very end of the TTL
    stream = in_files(spark, tmp_path, "k BIGINT, event_id BIGINT, ts TIMESTAMP_NTZ", [rows[i::3] for i in range(3)])
    got = drain(spark, stream, lambda s: jobs.ttl_cache(s, "k", 3600, "5 days"), at(3000), "5 days")
    want, filled = {}, {}
    for k, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = k in filled and ts - filled[k] <= timedelta(hours=1)
        if not want[i]:
            filled[k] = ts
    assert {r.event_id: r.hit for r in got} == want


@pytest.mark.parametrize("n", [1, 50])
def test_windows_carry_percentiles(spark, tmp_path, n):
    rows = [("ALLOW", float(v) if v else None, v % 3 == 0, 1, at(1)) for v in range(n)] + [("BLOCK", 7.0, False, 0, at(59))]
    ddl = "decision STRING, duration_ms DOUBLE, unknown BOOLEAN, shadow_findings INT, ts TIMESTAMP_NTZ"
    stream = in_files(spark, tmp_path, ddl, [rows[i::2] for i in range(2) if rows[i::2]])
    got = drain(spark, stream, lambda s: jobs.windowed_metrics(s, "1 hour", "1 day"), at(60), "1 day")
    found = {r.decision: r for r in got if r.decision}
    values = sorted(v for d, v, *_ in rows if d == "ALLOW" and v is not None)
    pick = lambda q: values[max(0, -(-int(q * 100) * len(values) // 100) - 1)] if values else None
    assert found["ALLOW"].n == n and (found["ALLOW"].duration_ms_p50, found["ALLOW"].duration_ms_p95) == (pick(0.5), pick(0.95))
    assert found["BLOCK"].duration_ms_p95 == 7.0


def test_marks_do_not_become_rows(spark, tmp_path):
    stream = in_files(spark, tmp_path, DDL, [actions(3, 1)])
    got = drain(spark, stream, lambda s: approvals.approval_states(s, SEATS), at(3), "10 minutes")
    assert sorted(r.seq for r in got) == [0, 1, 2]


class FakeState:
    """Value, list and map state in one, counting its calls."""

    calls = 0

    def __init__(self):
        self.value, self.items, self.map = None, [], {}

    def __getattribute__(self, name):
        if not name.startswith("_") and name not in ("value", "items", "map"):
            FakeState.calls += 1
        return object.__getattribute__(self, name)

    def exists(self): return self.value is not None or bool(self.items)
    def get(self): return iter(list(self.items)) if self.items else self.value
    def update(self, value): self.value = value
    def clear(self): self.value, self.items = None, []
    def appendValue(self, value): self.items.append(value)
    def appendList(self, values): self.items += values
    def put(self, values): self.items = list(values)
    def getValue(self, key): return self.map.get(key)
    def updateValue(self, key, value): self.map[key] = value
    def removeKey(self, key): del self.map[key]


class FakeHandle:
    def __init__(self): self.timers = set()
    def getValueState(self, *_): return FakeState()
    getListState = getMapState = getValueState
    def registerTimer(self, at): self.timers.add(at)
    def deleteTimer(self, at): self.timers.remove(at)


class At:
    def __init__(self, ms): self.ms = ms
    def getCurrentWatermarkInMs(self): return self.ms
    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_many_keys_share_the_calls_of_their_bucket():
    import pandas as pd

    processor, handle = approvals.ApprovalProcessor(SEATS, 1, 60_000), FakeHandle()
    processor.init(handle)
    payload = '{"action":"request_evidence","actor":"owner0"}'
    rows = [(f"c{n}", 1_000_000 + n, n, payload) for n in range(500)]
    FakeState.calls = 0
    list(processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "at", "seq", "payload"])]), At(0)))
    assert handle.timers == {1001}
    handle.timers.clear()
    opened = pd.concat(processor.handleExpiredTimer((0,), At(10_000), At(1001)))
    assert sorted(opened["key"]) == sorted(r[0] for r in rows) and set(opened["state"]) == {"evidence_requested"}
    assert len(handle.timers) == 1
    handle.timers.clear()
    closed = pd.concat(processor.handleExpiredTimer((0,), At(100_000), At(61_001)))
    assert len(closed) == 500 and set(closed["state"]) == {"escalated"} and not handle.timers
    # a read and a write of each record and wake, and some calls of the bucket
    assert FakeState.calls <= 2 * 2 * 500 + 30
