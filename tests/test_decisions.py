"""Ordered decision rules on small hand-written tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegate.operators import approvals, calibration, decisions, filters

FINDING = ("change_id INT, finding_id STRING, severity STRING, confidence DOUBLE, violated BOOLEAN, "
           "critical_unknown BOOLEAN, public_contract BOOLEAN, policy_mode STRING, required_approver STRING")


def finding(change, severity="high", confidence=1.0, violated=False, unknown=False, public=False,
            mode="blocking", approver=None):
    return (change, f"f{change}", severity, confidence, violated, unknown, public, mode, approver)


# change -> (findings, tests_passed, version_known, approved, required test, expected)
CASES = {
    1: ([finding(1, "critical", violated=True)], True, True, True, True, "BLOCK"),
    2: ([finding(2, unknown=True)], True, True, False, False, "REQUIRE_APPROVAL"),
    3: ([finding(3, unknown=True)], True, True, True, False, "ALLOW"),
    4: ([], None, True, True, True, "ALLOW_WITH_TESTS"),
    5: ([], False, False, True, True, "ALLOW_WITH_TESTS"),
    6: ([], True, False, False, False, "REQUIRE_APPROVAL"),
    7: ([finding(7, "low", violated=True, mode="warning")], True, True, False, False, "REQUIRE_APPROVAL"),
    8: ([finding(8, "low", public=True)], True, True, False, False, "REQUIRE_APPROVAL"),
    9: ([finding(9, "high", confidence=1.0, violated=True)], True, True, False, False, "ALLOW"),
    10: ([finding(10, "critical", confidence=0.7, violated=False, public=False)], True, True, False, False, "ALLOW"),
    11: ([finding(11, "critical", violated=True, mode="shadow")], True, True, False, False, "ALLOW"),
    12: ([finding(12, approver="a"), finding(12, approver="b")], True, True, False, False, "REQUIRE_APPROVAL"),
    13: ([], None, True, False, False, "ALLOW"),
}


def test_hard_gates_apply_in_order(spark):
    rows = [f for case in CASES.values() for f in case[0]]
    findings = spark.createDataFrame(rows, FINDING)
    changes = spark.createDataFrame(
        [(k, c[2], c[1], c[3]) for k, c in CASES.items()],
        "change_id INT, version_known BOOLEAN, tests_passed BOOLEAN, approval_satisfied BOOLEAN")
    required = spark.createDataFrame([(k, "t") for k, c in CASES.items() if c[4]], "change_id INT, test_id STRING")
    got = {r.change_id: r.decision for r in decisions.decide(changes, findings, required).collect()}
    assert got == {k: c[5] for k, c in CASES.items()}


def test_risk_threshold_and_cap(spark):
    findings = spark.createDataFrame([
        finding(1, "critical", 0.69, violated=True, mode="warning"), finding(2, "critical", 0.7, unknown=True),
        finding(3, "odd", 1.0, public=True), finding(4, "critical", 1.0)], FINDING)
    got = {r.change_id: r.risk_score for r in decisions.risk_scores(findings).collect()}
    assert got == pytest.approx({1: 0.69, 2: 0.7, 3: 0.35, 4: 0.0})


def test_eligibility_order(spark):
    rows = spark.createDataFrame([
        ("stale", None, "r2", "x", ["b"]), ("draft", "2020-01-01 00:00:00", "r1", "s", ["a"]),
        ("draft", None, "r2", "x", ["b"]), ("published", None, "r2", "x", ["b"]),
        ("published", None, "r1", "x", ["b"]), ("published", None, "r1", "global", ["b"]),
        ("published", "2024-02-01 00:00:00", "r1", "s", ["a"])],
        "status STRING, e STRING, revision STRING, scope STRING, acl ARRAY<STRING>")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    reason = filters.ineligible_reason(
        F.col("status"), F.col("e").cast("timestamp"), F.col("revision"), F.col("scope"), F.col("acl"),
        now=now, want_revision=F.lit("r1"), want_scope=F.lit("s"), roles=F.array(F.lit("a")))
    assert [r[0] for r in rows.select(reason).collect()] == [
        "stale", "stale", "status_not_published", "revision_mismatch", "scope_mismatch", "acl_denied", None]


def test_missing_evidence_is_not_success(spark):
    changes = spark.createDataFrame(
        [(1, None, "r1"), (2, None, "r1"), (3, None, "r1"), (4, None, "r1"), (5, False, "r1")],
        "change_id INT, tests_passed BOOLEAN, revision STRING")
    required = spark.createDataFrame([(2, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a")], "change_id INT, test_id STRING")
    evidence = spark.createDataFrame(
        [(2, "a", "r1", True), (3, "a", "r1", True), (4, "a", "r0", True), (5, "a", "r1", True)],
        "change_id INT, test_id STRING, revision STRING, passed BOOLEAN")
    got = {r.change_id: r.tests_ok for r in decisions.test_evidence_gate(changes, required, evidence).collect()}
    assert got == {1: True, 2: None, 3: True, 4: False, 5: False}


def test_lifecycle_promotes_one_stage_and_rolls_back(spark):
    rows = spark.createDataFrame([(m,) for m in calibration.MODES], "mode STRING")
    up, reason = calibration.promotion_step(F.col("mode"), F.lit(30), F.lit(0), F.lit(30), F.lit(0.02))
    down, _ = calibration.rollback_step(F.col("mode"))
    got = rows.select("mode", up, down).collect()
    assert [tuple(r) for r in got] == [
        ("draft", "shadow", "draft"), ("shadow", "warning", "draft"),
        ("warning", "blocking", "shadow"), ("blocking", "blocking", "warning")]


def test_batch_states_match_sequential_fold(spark):
    import random

    from tidegate.streaming.approvals import advance, empty_record

    rng = random.Random(5)
    kinds = ["delegate", "request_evidence", "add_evidence", "approve", "reject"]
    rows = []
    for seq in range(400):
        context = f"c{min(rng.randrange(30), 12)}"
        actor = rng.randrange(4)
        rows.append((context, seq, rng.choices(kinds, [2, 4, 4, 2, 1])[0], f"owner{actor}", f"owner{(actor + 1) % 4}"))
    events = spark.createDataFrame(rows, "context_id STRING, seq BIGINT, action STRING, actor STRING, delegate STRING")
    seats = ["owner0", "owner1", "owner2"]
    want, records = {}, {}
    for context, seq, action, actor, delegate in rows:
        records[context], outcome = advance(records.get(context, empty_record()), {"action": action, "actor": actor, "delegate": delegate}, seats, 1)
        want[seq] = (outcome, records[context]["state"])
    got = {r.seq: (r.outcome, r.state) for r in approvals.batch_states(events, seats, run=16).collect()}
    assert got == want


def test_cosigns_share_the_principal_slot():
    from tidegate.streaming.approvals import advance, empty_record

    record = empty_record()
    for action, actor, delegate in [("delegate", "a", "d"), ("approve", "d", None), ("approve", "a", None)]:
        record, outcome = advance(record, {"action": action, "actor": actor, "delegate": delegate}, ["a", "b"], 2)
        assert outcome == "ok"
    assert record["state"] == "pending" and record["signed"] == ["a"]
    assert advance(record, {"action": "approve", "actor": "x", "delegate": None}, ["a", "b"], 2)[1] != "ok"
    record, outcome = advance(record, {"action": "approve", "actor": "b", "delegate": None}, ["a", "b"], 2)
    assert outcome == "ok"
    assert record["state"] == "approved"
