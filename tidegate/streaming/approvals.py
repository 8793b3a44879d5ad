"""Approval requests as keyed state.

Each context is an event-sourced state machine with co-sign slots, delegation and waivers. Actions
are folded in the order of event time; the deadline of an open request and the end of a waiver are
timers that stand in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.approvals import OPEN_STATES, TRANSITIONS
from tidegate.streaming.ordered import InOrder, in_order

OUTPUT = "seq BIGINT, action STRING, outcome STRING, state STRING"
# The state an action asks for, and why an action is refused.
ASKS = {"request_evidence": "evidence_requested", "add_evidence": "pending", "approve": "approved", "reject": "rejected"}
NOT_APPROVER = "only configured approvers may delegate"
NOT_ENTITLED = "actor is not an approver or delegate"
ILLEGAL = "illegal approval transition"
BAD_WAIVER = "waiver requires scope, reason, and compensating control"
#: Outcome of an action that came after the watermark had passed its time; it changes nothing.
LATE = "late"
WAIVER = ("waiver_scope", "waiver_reason", "waiver_control", "waiver_until")
#: (state, action) pairs that the machine admits, with the state they lead to.
MOVES = {
    (state, action): target
    for state, allowed in TRANSITIONS.items() for action, target in ASKS.items() if target in allowed
}


def empty_record() -> dict:
    """A request nobody acted on: ``held`` gives each principal's delegate and its place in line."""
    return {"state": "pending", "signed": [], "held": {}}


def slot_of(record: dict, actor: str, seats: list[str]) -> str | None:
    """The slot an actor signs in: that of the first principal it stands in for, else its own seat."""
    principals = [(place, name) for name, (place, delegate) in record["held"].items() if delegate == actor]
    return min(principals)[1] if principals else actor if actor in seats else None


def advance(record: dict, event: dict, seats: list[str], cosigns: int) -> tuple[dict, str]:
    """The record after one action, and ``ok`` or why the action was refused."""
    action, actor = event["action"], event["actor"]
    if action == "delegate":
        if actor not in seats:
            return record, NOT_APPROVER
        place = record["held"].get(actor, [len(record["held"])])[0]
        return record | {"held": record["held"] | {actor: [place, event["delegate"]]}}, "ok"
    if action == "grant_waiver":
        if not all(event.get(field) for field in WAIVER):
            return record, BAD_WAIVER
        return record | {"waived_until": event["waiver_until"]}, "ok"
    slot = slot_of(record, actor, seats)
    if slot is None and action in ("approve", "reject"):
        return record, NOT_ENTITLED
    if action == "approve":
        signed = sorted({*record["signed"], slot})
        if len(signed) < cosigns:  # one of several signatures moves nothing
            return record | {"signed": signed}, "ok"
        record_if = record | {"signed": signed}
    else:
        record_if = record
    target = MOVES.get((record["state"], action))
    if target is None and action in ASKS:
        return record, ILLEGAL
    return record_if | {"state": target or record["state"]}, "ok"


class ApprovalProcessor(InOrder):
    """Folds approval actions per context, escalates what stays open too long, ends waivers."""

    columns = ("seq", "action", "outcome", "state")

    def __init__(self, approvers: list[str], cosigns: int = 1, deadline_ms: int | None = None) -> None:
        self.approvers, self.cosigns, self.deadline_ms = approvers, cosigns, deadline_ms

    def begin(self) -> dict:
        return empty_record()

    def step(self, record: dict, at: int, seq: int, payload: dict) -> tuple[dict, tuple]:
        if self.deadline_ms is not None and "opened" not in record:
            record = record | {"opened": at, "deadline": at + self.deadline_ms * 1000}
        record, outcome = advance(record, payload, self.approvers, self.cosigns)
        return record, (seq, payload["action"], outcome, record["state"])

    def late(self, record: dict, at: int, seq: int, payload: dict) -> tuple:
        return seq, payload["action"], LATE, record["state"]

    def wakes(self, record: dict) -> list[int]:
        """The deadline while the request is open, and the end of the waiver in force."""
        open_ = record["state"] in OPEN_STATES
        moments = (record.get("deadline") if open_ else None, record.get("waived_until"))
        return [m for m in moments if m is not None]

    def wake(self, record: dict, at: int) -> tuple[dict, tuple | None]:
        if record.get("waived_until") == at:
            return record | {"waived_until": None}, (-1, "expire_waiver", "ok", record["state"])
        return record | {"deadline": None, "state": "escalated"}, (-1, "escalate", "ok", "escalated")


def approval_states(
    events: DataFrame, approvers: list[str], cosigns: int = 1, deadline_ms: int | None = None,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Outcome and state after every action in the order of ``ts``, then ``seq``.

    ``events`` has context_id, seq, ts, action, actor, delegate, and for waivers ``WAIVER`` with
    the end as a timestamp. An action is given out once the watermark has passed it; one that
    comes later than ``lateness`` behind the latest is given out as late. With a deadline, what is
    still open that long after its first action is escalated. Rows of a context with equal time
    and sequence number count once.
    """
    has = set(events.columns)
    fields = [F.col(c) if c in has else F.lit(None).cast("string").alias(c) for c in ("action", "actor", "delegate", *WAIVER[:3])]
    until = F.unix_micros(F.col(WAIVER[3]).cast("timestamp")) if WAIVER[3] in has else F.lit(None).cast("bigint")
    return in_order(
        events, "context_id", "ts", "seq", F.struct(*fields, until.alias(WAIVER[3])), lateness,
        ApprovalProcessor(approvers, cosigns, deadline_ms), OUTPUT,
    )
