"""Decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query
from tidegate.catalog.oracle_views import add_view
from tidegate.operators import decisions as ops

add_view("decided", "changes findings required", """
    SELECT change_id, risk_score, branch,
      CASE branch WHEN 'critical' THEN 'BLOCK' WHEN 'tests' THEN 'ALLOW_WITH_TESTS'
        WHEN 'clear' THEN 'ALLOW' ELSE 'REQUIRE_APPROVAL' END AS decision,
      CASE branch WHEN 'critical' THEN 'critical policy violation'
        WHEN 'unknown' THEN 'critical boundary or version is unknown'
        WHEN 'tests' THEN 'required test evidence is missing'
        WHEN 'warning' THEN 'warning policy requires approval'
        WHEN 'public' THEN 'public contract or multiple owners'
        WHEN 'risk' THEN 'risk score requires approval'
        ELSE 'all hard conditions and test evidence satisfied' END AS rationale
    FROM (
      SELECT c.change_id, round(least(1.0, coalesce(top, 0.0)), 6) AS risk_score,
        CASE WHEN crit THEN 'critical'
          WHEN (unk OR NOT version_known) AND NOT approval_satisfied THEN 'unknown'
          WHEN r.change_id IS NOT NULL AND tests_passed IS NOT TRUE THEN 'tests'
          WHEN warn AND NOT approval_satisfied THEN 'warning'
          WHEN (pub OR owners > 1) AND NOT approval_satisfied THEN 'public'
          WHEN coalesce(top, 0.0) >= 0.7 AND NOT approval_satisfied THEN 'risk'
          ELSE 'clear' END AS branch
      FROM changes c
      LEFT JOIN (SELECT change_id,
          bool_or(violated AND severity = 'critical' AND policy_mode = 'blocking') AS crit,
          bool_or(critical_unknown) AS unk, bool_or(violated AND policy_mode = 'warning') AS warn,
          bool_or(public_contract) AS pub, count(DISTINCT required_approver) AS owners,
          max(CASE WHEN violated OR critical_unknown OR public_contract THEN
            CASE severity WHEN 'low' THEN 0.15::DOUBLE WHEN 'medium' THEN 0.35 WHEN 'high' THEN 0.65
              WHEN 'critical' THEN 1.0 ELSE 0.35 END * confidence END) AS top
        FROM findings WHERE policy_mode NOT IN ('draft', 'shadow') GROUP BY 1) f USING (change_id)
      LEFT JOIN (SELECT DISTINCT change_id FROM required) r USING (change_id))""")


def decided(w):
    return ops.decide(w.changes, w.findings, w.required)


@query("four_state_decision", "SELECT change_id, decision, rationale, risk_score FROM decided",
       "decided")
def four_state_decision(w):
    return decided(w).select("change_id", "decision", "rationale", "risk_score")


@query("risk_score", """
    SELECT change_id, round(least(1.0, coalesce(max(CASE
        WHEN violated OR critical_unknown OR public_contract THEN
          CASE severity WHEN 'low' THEN 0.15::DOUBLE WHEN 'medium' THEN 0.35 WHEN 'high' THEN 0.65
            WHEN 'critical' THEN 1.0 ELSE 0.35 END * confidence END), 0.0)), 6) AS risk_score
    FROM findings WHERE policy_mode NOT IN ('draft', 'shadow') GROUP BY 1""", "findings")
def risk_score(w):
    return ops.risk_scores(w.findings).select("change_id", F.round("risk_score", 6).alias("risk_score"))


@query("decision_evidence", """
    SELECT f.change_id, 'evidence' AS role, finding_id AS ref
    FROM findings f JOIN decided d USING (change_id)
    WHERE policy_mode NOT IN ('draft', 'shadow') AND (
      (branch = 'critical' AND violated AND severity = 'critical' AND policy_mode = 'blocking')
      OR (branch = 'unknown' AND critical_unknown)
      OR (branch = 'warning' AND violated AND policy_mode = 'warning')
      OR (branch = 'public' AND public_contract))
    UNION ALL
    SELECT DISTINCT f.change_id, 'approver', required_approver
    FROM findings f JOIN decided d USING (change_id)
    WHERE policy_mode NOT IN ('draft', 'shadow') AND decision = 'REQUIRE_APPROVAL'
    UNION ALL
    SELECT r.change_id, 'test', test_id FROM required r JOIN decided d USING (change_id)
    WHERE decision = 'ALLOW_WITH_TESTS'
    UNION ALL
    SELECT change_id, 'shadow', finding_id FROM findings
    WHERE policy_mode IN ('draft', 'shadow') AND (violated OR critical_unknown)""",
       "findings required decided")
def decision_evidence(w):
    return ops.decision_references(decided(w), w.findings, w.required)


@query("approver_union", """
    SELECT change_id, required_approver AS approver FROM findings
    WHERE policy_mode NOT IN ('draft', 'shadow')
    UNION
    SELECT o_orderkey, 'owner' || (o_custkey % 3) FROM orders""", "findings")
def approver_union(w):
    owners = w.table("orders").selectExpr(
        "o_orderkey AS change_id", "concat('owner', o_custkey % 3) AS approver")
    return ops.approver_rows(w.findings, owners)


@query("active_findings", """
    SELECT finding_id, policy_mode, CASE WHEN policy_mode IN ('draft', 'shadow') THEN 'shadow'
      ELSE 'active' END AS bucket
    FROM findings
    WHERE policy_mode NOT IN ('draft', 'shadow') OR violated OR critical_unknown""", "findings")
def active_findings(w):
    live = ops.active_findings(w.findings).withColumn("bucket", F.lit("active"))
    hits = ops.shadow_hits(w.findings).withColumn("bucket", F.lit("shadow"))
    return live.unionByName(hits).select("finding_id", "policy_mode", "bucket")


@query("next_actions", """
    SELECT change_id, decision,
      CASE WHEN decision = 'REQUIRE_APPROVAL' AND NOT ctx AND parsed THEN 'prepare_change'
        WHEN decision = 'REQUIRE_APPROVAL' AND ctx AND appr THEN 'request_approval'
        ELSE 'none' END AS tool,
      CASE WHEN decision = 'REQUIRE_APPROVAL' THEN
          CASE WHEN NOT ctx AND NOT parsed
              THEN 'provide a valid unified diff before preparing a change context'
            WHEN NOT ctx THEN 'an approval must be bound to a persisted change context'
            WHEN NOT appr THEN 'register a governed approver before creating an approval request'
            ELSE rationale END
        WHEN decision = 'ALLOW_WITH_TESTS'
          THEN 'trusted CI must execute and attest the required tests'
        ELSE 'resolve blocking findings before retrying' END AS reason
    FROM (SELECT d.*, change_id % 3 <> 0 AS ctx, change_id % 4 <> 1 AS parsed,
        change_id IN (SELECT change_id FROM findings
          WHERE policy_mode NOT IN ('draft', 'shadow')) AS appr FROM decided d)
    WHERE decision <> 'ALLOW'""", "decided")
def next_actions(w):
    named = ops.approver_rows(w.findings).groupBy("change_id").agg(F.lit(True).alias("named"))
    ready = decided(w).join(named, "change_id", "left").withColumns({
        "has_context": F.expr("change_id % 3 <> 0"),
        "parsed": F.expr("change_id % 4 <> 1"),
        "has_approvers": F.coalesce("named", F.lit(False)),
    })
    return ops.next_actions(ready).select("change_id", "decision", "tool", "reason")


@query("exit_code", """
    SELECT task_id, state, CASE state WHEN 'ALLOW' THEN 0 WHEN 'ALLOW_WITH_TESTS' THEN 1
      WHEN 'REQUIRE_APPROVAL' THEN 1 WHEN 'BLOCK' THEN 1 ELSE 2 END AS gate_code,
      CASE legacy WHEN 'ALLOW' THEN 0 WHEN 'BLOCK' THEN 1 ELSE
        CASE fault WHEN 'input_validation' THEN 2 WHEN 'diff_parse' THEN 3
          WHEN 'policy_uncovered' THEN 4 WHEN 'retrieval_empty' THEN 5
          WHEN 'embedding_timeout' THEN 6 WHEN 'cache_corrupt' THEN 7 ELSE 3 END END AS legacy_code
    FROM (SELECT task_id, CASE prediction WHEN 'allow' THEN 'ALLOW' WHEN 'tests' THEN 'ALLOW_WITH_TESTS'
          WHEN 'approval' THEN 'REQUIRE_APPROVAL' ELSE CASE WHEN impact THEN 'BLOCK' ELSE 'OTHER' END END AS state,
        CASE prediction WHEN 'allow' THEN 'ALLOW' WHEN 'block' THEN 'BLOCK' ELSE 'CHECK_INCOMPLETE' END AS legacy,
        ['input_validation', 'diff_parse', 'policy_uncovered', 'retrieval_empty', 'embedding_timeout',
         'cache_corrupt', 'mcp_disconnected'][task_id % 7 + 1] AS fault FROM predictions)""",
       "predictions")
def exit_code(w):
    rows = w.predictions.selectExpr(
        "task_id",
        "CASE prediction WHEN 'allow' THEN 'ALLOW' WHEN 'tests' THEN 'ALLOW_WITH_TESTS' "
        "WHEN 'approval' THEN 'REQUIRE_APPROVAL' ELSE IF(impact, 'BLOCK', 'OTHER') END AS state",
        "CASE prediction WHEN 'allow' THEN 'ALLOW' WHEN 'block' THEN 'BLOCK' "
        "ELSE 'CHECK_INCOMPLETE' END AS legacy",
        "element_at(array('input_validation', 'diff_parse', 'policy_uncovered', 'retrieval_empty', "
        "'embedding_timeout', 'cache_corrupt', 'mcp_disconnected'), cast(task_id % 7 + 1 AS INT)) "
        "AS fault",
    )
    return rows.select("task_id", "state", ops.gate_exit_code("state").alias("gate_code"),
                       ops.legacy_exit_code("legacy", "fault").alias("legacy_code"))


@query("legacy_state_map", """
    WITH cards AS (SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK'
        ELSE 'CHECK_INCOMPLETE' END AS decision FROM (SELECT DISTINCT user_id FROM events)),
      faults AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'policy_uncovered'
          WHEN 'view' THEN 'retrieval_empty' WHEN 'purchase' THEN 'embedding_timeout'
          WHEN 'signup' THEN 'mcp_disconnected' ELSE 'diff_parse' END AS code FROM events
          WHERE event_type <> 'error' OR value > 20)
    SELECT user_id AS card_id, decision, fault, CASE WHEN decision <> 'CHECK_INCOMPLETE' THEN decision
        WHEN fault IN ('policy_uncovered', 'retrieval_empty', 'embedding_timeout', 'mcp_disconnected')
          THEN 'REQUIRE_APPROVAL' ELSE 'BLOCK' END AS state
    FROM cards LEFT JOIN (SELECT user_id, code AS fault FROM faults
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY code <> 'diff_parse', event_id) = 1)
      USING (user_id)""")
def legacy_state_map(w):
    events = w.table("events")
    cards = events.select("user_id").distinct().selectExpr(
        "user_id AS card_id", "CASE user_id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'BLOCK' "
        "ELSE 'CHECK_INCOMPLETE' END AS decision")
    faults = events.where("event_type <> 'error' OR value > 20").selectExpr(
        "user_id AS card_id", "event_id AS seq",
        "CASE event_type WHEN 'click' THEN 'policy_uncovered' WHEN 'view' THEN 'retrieval_empty' "
        "WHEN 'purchase' THEN 'embedding_timeout' WHEN 'signup' THEN 'mcp_disconnected' "
        "ELSE 'diff_parse' END AS code")
    return ops.legacy_state(cards, faults)


@query("unknown_reason_state", """
    SELECT event_id, reason, CASE WHEN reason IN ('INDEX_LAG', 'REVISION_MISMATCH',
        'PERMISSION_DENIED', 'DYNAMIC_BOUNDARY') THEN 'REQUIRE_APPROVAL'
      WHEN reason = 'TEST_EVIDENCE_MISSING' THEN 'ALLOW_WITH_TESTS' ELSE 'BLOCK' END AS state
    FROM (SELECT event_id, ['INDEX_LAG', 'REVISION_MISMATCH', 'PERMISSION_DENIED',
      'DYNAMIC_BOUNDARY', 'TEST_EVIDENCE_MISSING', 'MALFORMED_INPUT', 'UNSUPPORTED_DIFF',
      'UNKNOWN'][event_id % 8 + 1] AS reason FROM events)""")
def unknown_reason_state(w):
    return w.table("events").selectExpr(
        "event_id", "element_at(array('INDEX_LAG', 'REVISION_MISMATCH', 'PERMISSION_DENIED', "
        "'DYNAMIC_BOUNDARY', 'TEST_EVIDENCE_MISSING', 'MALFORMED_INPUT', 'UNSUPPORTED_DIFF', "
        "'UNKNOWN'), cast(event_id % 8 + 1 AS INT)) AS reason",
    ).withColumn("state", ops.unknown_reason_state())


@query("test_evidence_gate", """
    SELECT c.change_id, CASE WHEN r.change_id IS NULL THEN true
        WHEN tests_passed IS NOT NULL THEN tests_passed
        WHEN missing > 0 THEN NULL ELSE ok END AS tests_ok
    FROM changes c LEFT JOIN (
      SELECT r.change_id, count(*) FILTER (e.passed IS NULL) AS missing,
        bool_and(e.passed AND e.revision = c.revision) AS ok
      FROM required r JOIN changes c USING (change_id)
      LEFT JOIN evidence e ON e.change_id = r.change_id AND e.test_id = r.test_id
      GROUP BY 1) r USING (change_id)""", "changes required evidence")
def test_evidence_gate(w):
    return ops.test_evidence_gate(w.changes, w.required, w.evidence)


@query("outcome_contradictions", """
    SELECT change_id, decision, array_to_string(list_filter([
        CASE WHEN decision = 'ALLOW' AND failed THEN 'ALLOW decision contains a failed or incomplete finding' END,
        CASE WHEN decision = 'REQUIRE_APPROVAL' AND NOT coalesce(reason, false)
          THEN 'REQUIRE_APPROVAL decision lacks an unknown reason' END,
        CASE WHEN decision <> 'BLOCK' AND blocked THEN 'blocking violation but is not BLOCK' END],
        lambda x: x IS NOT NULL), '; ') AS problems
    FROM decided LEFT JOIN (SELECT change_id, bool_or(violated OR critical_unknown) AS failed,
        bool_or(critical_unknown) AS reason, bool_or(violated AND policy_mode = 'blocking') AS blocked
      FROM findings GROUP BY 1) USING (change_id)
    WHERE (decision = 'ALLOW' AND failed) OR (decision = 'REQUIRE_APPROVAL' AND NOT coalesce(reason, false))
      OR (decision <> 'BLOCK' AND blocked)""", "decided")
def outcome_contradictions(w):
    return ops.outcome_contradictions(decided(w), w.findings).withColumn(
        "problems", F.array_join("problems", "; "))
