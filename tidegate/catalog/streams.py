"""Streaming queries: each drains a stream over the events table and reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import session
from tidegate.catalog.base import query
from tidegate.catalog.oracle_views import add_view
from tidegate.catalog.sources import AUDIT_SQL, audit_events, read_audit
from tidegate.operators.approvals import batch_states
from tidegate.plans.views import Warehouse
from tidegate.streaming import approvals, jobs, runner

APPROVERS = ["owner0", "owner1", "owner2"]


LATENESS = "10 minutes"


class Live(Warehouse):
    """The same views over streamed tables."""

    def table(self, name):
        return runner.table_stream(self.spark, self.folder, name)


def live(w):
    return Live(w.spark, w.folder)


def closing(w):
    """A clock, and what marks the end of the events on it."""
    clock = runner.Clock(w.spark)
    return clock, lambda: clock.mark(w.table("events").select(F.col("ts").cast("timestamp_ntz")), LATENESS)


def actions(w):
    return w.approval_events.withColumn(
        "delegate", F.expr("concat('owner', (cast(right(actor, 1) AS INT) + 1) % 4)"))


STATES_SQL = """
    WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY seq) AS n,
        actor IN ('owner0', 'owner1', 'owner2') AS seat FROM approval_events),
      st(context_id, n, seq, action, outcome, state, open3) AS (
        SELECT DISTINCT context_id, 0::BIGINT, -1::BIGINT, '', '', 'pending', false FROM ev
        UNION ALL
        SELECT context_id, e_n, e_seq, e_action, CASE WHEN refusal IS NOT NULL THEN refusal WHEN target IS NULL OR target = '' THEN
            CASE WHEN target IS NULL THEN 'illegal approval transition' ELSE 'ok' END ELSE 'ok' END,
          CASE WHEN refusal IS NULL AND target <> '' THEN target ELSE state END,
          open3 OR (e_action = 'delegate' AND e_actor = 'owner2')
        FROM (SELECT st.context_id, e.n AS e_n, e.seq AS e_seq, e.action AS e_action, e.actor AS e_actor, st.state, st.open3,
            CASE WHEN e.action = 'delegate' AND NOT e.seat THEN 'only configured approvers may delegate'
              WHEN e.action IN ('approve', 'reject') AND NOT e.seat AND NOT (e.actor = 'owner3' AND st.open3)
                THEN 'actor is not an approver or delegate' END AS refusal,
            CASE WHEN e.action = 'delegate' THEN ''
              WHEN e.action = 'request_evidence' AND st.state = 'pending' THEN 'evidence_requested'
              WHEN e.action = 'add_evidence' AND st.state IN ('pending', 'evidence_requested') THEN 'pending'
              WHEN e.action = 'approve' AND st.state = 'pending' THEN 'approved'
              WHEN e.action = 'reject' AND st.state IN ('pending', 'evidence_requested') THEN 'rejected' END AS target
          FROM st JOIN ev e ON e.context_id = st.context_id AND e.n = st.n + 1))
    SELECT context_id, seq, action, outcome, state FROM st WHERE n > 0"""


@query("stream_approval_state", STATES_SQL, "approval_events")
def stream_approval_state(w):
    clock, close = closing(w)
    states = approvals.approval_states(clock.beside(actions(live(w))), APPROVERS, lateness=LATENESS)
    return runner.run_to_table(states, "approvals", then=close)


@query("approval_state_batch", STATES_SQL, "approval_events")
def approval_state_batch(w):
    return batch_states(actions(w), APPROVERS)


# Rejections of every third event grant a waiver instead, some of them without a control.
WAIVED = """CASE WHEN action = 'reject' AND seq % 3 <> 1 THEN 'grant_waiver' ELSE action END"""
PATIENCE_HOURS, COSIGNS = 3, 2

add_view("timeline", "approval_events", f"""
    WITH acts AS (SELECT context_id, seq, ts, {WAIVED} AS action, actor, (right(actor, 1))::INT AS k,
        seq % 5 <> 0 AS has_control, epoch_us(ts) AS moment FROM approval_events),
      passed AS (SELECT (epoch_us(max(ts)) // 1000 + 2) * 1000 AS upto FROM events),
      marks AS (SELECT context_id, min(moment) + {PATIENCE_HOURS}::BIGINT * 3600000000 AS moment, 'escalate' AS action FROM acts GROUP BY 1),
      ends AS (SELECT context_id, moment + (1 + seq % 4) * 3600000000 AS moment, seq AS granted FROM acts
        WHERE action = 'grant_waiver' AND has_control)
    SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY moment, kind, seq) AS n FROM (
      SELECT context_id, moment, 2 AS kind, seq, action, k, has_control, NULL::BIGINT AS granted FROM acts
      UNION ALL SELECT context_id, moment, 1, -1, action, NULL, NULL, NULL FROM marks, passed WHERE moment < upto
      UNION ALL SELECT context_id, moment, 0, -1, 'expire_waiver', NULL, NULL, granted FROM ends, passed WHERE moment < upto)""")


@query("stream_escalation", f"""
    WITH RECURSIVE line AS MATERIALIZED (SELECT * FROM timeline),
      st(context_id, n, seq, action, outcome, state, d0, d1, d2, s0, s1, s2, waiver, shown) AS (
        SELECT DISTINCT context_id, 0::BIGINT, -1::BIGINT, '', '', 'pending', false, false, false, false, false, false, -1::BIGINT, false FROM line
        UNION ALL
        SELECT context_id, n, seq, action,
          CASE WHEN refusal IS NOT NULL THEN refusal ELSE 'ok' END,
          CASE WHEN refusal IS NULL THEN coalesce(target, state) ELSE state END,
          d0 OR (action = 'delegate' AND k = 0), d1 OR (action = 'delegate' AND k = 1), d2 OR (action = 'delegate' AND k = 2),
          s0 OR (signs AND refusal IS NULL AND slot = 0), s1 OR (signs AND refusal IS NULL AND slot = 1),
          s2 OR (signs AND refusal IS NULL AND slot = 2),
          CASE WHEN action = 'grant_waiver' AND refusal IS NULL THEN seq WHEN action = 'expire_waiver' AND waiver = granted THEN -1 ELSE waiver END,
          CASE action WHEN 'escalate' THEN state IN ('pending', 'evidence_requested') WHEN 'expire_waiver' THEN waiver = granted ELSE true END
        FROM (SELECT *, CASE WHEN action = 'delegate' AND k = 3 THEN 'only configured approvers may delegate'
              WHEN action = 'grant_waiver' AND NOT has_control THEN 'waiver requires scope, reason, and compensating control'
              WHEN action IN ('approve', 'reject') AND slot IS NULL THEN 'actor is not an approver or delegate'
              WHEN action IN ('request_evidence', 'add_evidence', 'reject') AND target IS NULL THEN 'illegal approval transition'
              WHEN action = 'approve' AND signed >= {COSIGNS} AND target IS NULL THEN 'illegal approval transition' END AS refusal
          FROM (SELECT *, CASE action WHEN 'request_evidence' THEN CASE WHEN state = 'pending' THEN 'evidence_requested' END
                WHEN 'add_evidence' THEN CASE WHEN state IN ('pending', 'evidence_requested') THEN 'pending' END
                WHEN 'approve' THEN CASE WHEN signed < {COSIGNS} THEN state WHEN state IN ('pending', 'escalated') THEN 'approved' END
                WHEN 'reject' THEN CASE WHEN state IN ('pending', 'evidence_requested', 'escalated') THEN 'rejected' END
                WHEN 'escalate' THEN CASE WHEN state IN ('pending', 'evidence_requested') THEN 'escalated' END END AS target,
              action = 'approve' AS signs
            FROM (SELECT *, (s0 OR slot = 0)::INT + (s1 OR slot = 1)::INT + (s2 OR slot = 2)::INT AS signed
              FROM (SELECT l.context_id, l.n, l.seq, l.action, l.k, l.has_control, l.granted, st.state, st.d0, st.d1, st.d2,
                  st.s0, st.s1, st.s2, st.waiver,
                  CASE WHEN k = 1 AND d0 THEN 0 WHEN k = 2 AND d1 THEN 1 WHEN k = 3 AND d2 THEN 2 WHEN k < 3 THEN k END AS slot
                FROM st JOIN line l ON l.context_id = st.context_id AND l.n = st.n + 1)))))
    SELECT context_id, seq, action, outcome, state FROM st WHERE n > 0 AND shown""", "timeline")
def stream_escalation(w):
    """Two signatures, three hours for each request, waivers of one to four hours."""
    clock, close = closing(w)
    acts = actions(live(w)).withColumns({
        "action": F.expr(WAIVED), "waiver_scope": F.lit("change"), "waiver_reason": F.lit("incident"),
        "waiver_control": F.expr("IF(seq % 5 = 0, '', 'monitor')"),
        "waiver_until": F.expr("ts + make_dt_interval(0, cast(1 + seq % 4 AS INT))"),
    })
    states = approvals.approval_states(
        clock.beside(acts), APPROVERS, COSIGNS, PATIENCE_HOURS * 3600 * 1000, LATENESS)
    return runner.run_to_table(states, "escalations", then=close)


@query("stream_idempotent_create", "SELECT DISTINCT user_id, event_type FROM events")
def stream_idempotent_create(w):
    created = jobs.idempotent_create(live(w).table("events").select("user_id", "event_type"), ["user_id", "event_type"])
    return runner.run_to_table(created, "created")


@query("stream_metrics_window", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, decision, count(*) AS n,
      count_if(unknown)::BIGINT AS unknowns, sum(shadow_findings)::BIGINT AS shadow_hit_count,
      round(sum(duration_ms), 4) AS duration_ms_total, max(duration_ms) AS duration_ms_max,
      quantile_disc(duration_ms, 0.5) AS duration_ms_p50, quantile_disc(duration_ms, 0.95) AS duration_ms_p95,
      round(count_if(unknown) / count(*), 6) AS unknown_rate, count(*) < 5 AS low_sample
    FROM metrics GROUP BY 1, 2""", "metrics")
def stream_metrics_window(w):
    """All windows, the last ones closed by a mark an hour after the last event."""
    clock = runner.Clock(w.spark)
    rows = clock.beside(live(w).metrics)
    closed = runner.run_to_table(
        jobs.windowed_metrics(rows, "1 hour", LATENESS), "windows",
        then=lambda: clock.mark(w.table("events").select(F.col("ts").cast("timestamp_ntz")), "70 minutes"))
    return closed.where("decision IS NOT NULL").withColumns({
        "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"),
        "duration_ms_total": F.round("duration_ms_total", 4), "unknown_rate": F.round("unknown_rate", 6)})


@query("stream_ttl_cache", """
    WITH RECURSIVE fills(user_id, filled) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
      UNION ALL SELECT user_id, (SELECT min(ts) FROM events e WHERE e.user_id = f.user_id AND e.ts > f.filled + INTERVAL 12 HOUR)
      FROM fills f WHERE filled IS NOT NULL)
    SELECT event_id, NOT EXISTS (SELECT 1 FROM fills f WHERE f.user_id = e.user_id AND f.filled = e.ts) AS hit FROM events e""")
def stream_ttl_cache(w):
    clock, close = closing(w)
    uses = live(w).table("events").select("user_id", "event_id", "ts")
    marked = jobs.ttl_cache(clock.beside(uses), "user_id", 12 * 3600, LATENESS)
    return runner.run_to_table(marked, "ttl", then=close).select("event_id", "hit")


@query("stream_late_revision", """
    SELECT event_id, CASE WHEN 'r' || (event_id % 3) = 'r' || (c_nationkey % 3) THEN 'OK' ELSE 'INDEX_LAG' END AS status
    FROM events LEFT JOIN customer ON c_custkey = user_id""")
def stream_late_revision(w):
    pins = w.table("customer").selectExpr("c_custkey AS user_id", "concat('r', c_nationkey % 3) AS revision")
    events = live(w).table("events").selectExpr("event_id", "user_id", "concat('r', event_id % 3) AS revision")
    root = session.scratch_dir(w.spark, "revisions")

    def route(batch, number):
        # One pass, one folder per batch and status; a batch that is tried again replaces its own.
        batch.write.mode("overwrite").partitionBy("status").parquet(f"{root}/batch={number}")

    runner.run_batches(jobs.late_revisions(events, pins, "user_id"), "revisions", route)
    return w.spark.read.parquet(root).select("event_id", "status")


@query("stream_redacted_audit", AUDIT_SQL)
def stream_redacted_audit(w):
    folder = session.scratch_dir(w.spark, "live-audit")
    stream = jobs.redacted_audit(audit_events(live(w).table("events")))
    job = (stream.writeStream.format("json").option("path", folder)
           .option("checkpointLocation", session.scratch_dir(w.spark, "live-audit-log"))
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return read_audit(w, folder)
