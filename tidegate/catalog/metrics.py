"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query
from tidegate.catalog.oracle_views import add_view
from tidegate.operators import approvals, calibration, decisions, metrics, ordered


def rounded(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query("decision_distribution",
       "SELECT event_type AS decision, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def decision_distribution(w):
    return metrics.decision_distribution(w.metrics)


@query("percentile_linear", """
    SELECT event_type, round(quantile_cont(value, 0.5)::DOUBLE, 6) AS p50,
      round(quantile_cont(value, 0.95)::DOUBLE, 6) AS p95, round(quantile_cont(value, 0.99)::DOUBLE, 6) AS p99
    FROM events GROUP BY 1""")
def percentile_linear(w):
    return rounded(ordered.exact_percentiles(
        w.table("events"), ["event_type"], "value", [50.0, 95.0, 99.0]), "p50", "p95", "p99")


@query("ops_metrics", """
    SELECT count(*) AS n, round(avg((unknown)::INT), 6) AS unknown_rate,
      sum(shadow_findings)::BIGINT AS shadow_hit_count,
      round(avg((shadow_findings > 0)::INT), 6) AS shadow_hit_rate,
      round(quantile_cont(duration_ms, 0.5)::DOUBLE, 6) AS duration_ms_p50,
      round(quantile_cont(duration_ms, 0.95)::DOUBLE, 6) AS duration_ms_p95, count(*) < 5 AS low_sample
    FROM metrics""", "metrics")
def ops_metrics(w):
    return rounded(metrics.ops_metrics(w.metrics, []), "unknown_rate", "shadow_hit_rate",
                   "duration_ms_p50", "duration_ms_p95")


@query("confusion_matrix", """
    SELECT truth, count(*) FILTER (prediction = 'allow') AS allow,
      count(*) FILTER (prediction = 'tests') AS tests,
      count(*) FILTER (prediction = 'approval') AS approval,
      count(*) FILTER (prediction = 'block') AS block FROM predictions GROUP BY 1""", "predictions")
def confusion_matrix(w):
    return metrics.confusion_matrix(w.predictions)


add_view("class_scores", "predictions", """
    SELECT state, tp / greatest(called, 1) AS precision, tp / greatest(actual, 1) AS recall,
      CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (called + actual) END AS f1
    FROM (SELECT s.state, (count(*) FILTER (truth = s.state AND prediction = s.state))::DOUBLE AS tp,
        count(*) FILTER (prediction = s.state) AS called, count(*) FILTER (truth = s.state) AS actual
      FROM predictions, (VALUES ('allow'), ('tests'), ('approval'), ('block')) s(state) GROUP BY 1)""")


@query("class_prf", """SELECT state, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6)::DOUBLE AS f1 FROM class_scores""", "class_scores")
def class_prf(w):
    return rounded(metrics.class_scores(w.predictions), "precision", "recall", "f1")


@query("gate_quality", """
    SELECT round((SELECT sum(f1) / 4 FROM class_scores), 6)::DOUBLE AS macro_f1,
      round((SELECT recall FROM class_scores WHERE state = 'block'), 6) AS critical_violation_recall,
      round((SELECT precision FROM class_scores WHERE state = 'approval'), 6) AS approval_precision,
      round((SELECT recall FROM class_scores WHERE state = 'approval'), 6) AS approval_recall,
      round((SELECT recall FROM class_scores WHERE state = 'tests'), 6) AS required_test_recall,
      round(count(*) FILTER (truth = 'block' AND prediction = 'allow') / count(*) FILTER (truth = 'block'), 6)
        AS unsafe_allow_rate,
      round(count(*) FILTER (truth <> 'block' AND prediction = 'block') / count(*) FILTER (truth <> 'block'), 6)
        AS false_block_rate,
      round(count(*) FILTER (impact AND prediction <> 'allow') / count(*) FILTER (impact), 6) AS impact_recall
    FROM predictions""", "class_scores")
def gate_quality(w):
    result = metrics.gate_quality(w.predictions)
    return rounded(result, *result.columns)


@query("duration_summary", """
    SELECT event_type, round(avg(value), 6) AS avg, count(*) AS n,
      round(quantile_cont(value, 0.5)::DOUBLE, 6) AS p50, round(quantile_cont(value, 0.95)::DOUBLE, 6) AS p95
    FROM events GROUP BY 1""")
def duration_summary(w):
    return rounded(metrics.duration_summary(w.table("events"), ["event_type"], "value"),
                   "avg", "p50", "p95")


add_view("report", "observations", """
    SELECT policy_id, count(*) AS samples, count(*) FILTER (expected_violation) AS positives,
      count(*) FILTER (NOT expected_violation) AS negatives,
      count(*) FILTER (expected_violation IS NULL) AS unknowns,
      count(*) FILTER (NOT expected_violation AND policy_triggered) AS false_positives,
      count(*) FILTER (expected_violation AND NOT policy_triggered) AS false_negatives,
      coalesce(count(*) FILTER (NOT expected_violation AND policy_triggered)
        / nullif(count(*) FILTER (NOT expected_violation), 0), 0.0) AS false_positive_rate,
      coalesce(count(*) FILTER (expected_violation AND NOT policy_triggered)
        / nullif(count(*) FILTER (expected_violation), 0), 0.0) AS false_negative_rate,
      count(*) FILTER (expected_violation IS NULL) / count(*) AS unknown_rate
    FROM observations GROUP BY 1""")


@query("calibration_report", """SELECT * REPLACE (round(false_positive_rate, 6) AS false_positive_rate,
    round(false_negative_rate, 6) AS false_negative_rate, round(unknown_rate, 6) AS unknown_rate)
    FROM report""", "report")
def calibration_report(w):
    return rounded(calibration.calibration_report(w.observations),
                   "false_positive_rate", "false_negative_rate", "unknown_rate")


# One promotion request per policy (document source), facts assigned by source number.
add_view("bundles", "observations", """
    SELECT policy_id, k, ['draft', 'shadow', 'warning', 'blocking'][k % 4 + 1] AS mode,
      ['draft', 'shadow', 'warning'][k % 3 + 1] AS from_mode,
      ['shadow', 'warning', 'blocking'][(k + k // 9) % 3 + 1] AS target_mode,
      CASE WHEN k % 5 = 0 THEN 'medium' ELSE 'high' END AS precision,
      'owner' || (k % 4) AS owner, 'owner' || (k % 4 + k // 15) AS approval_owner,
      k % 7 <> 3 AS approved_late, CASE WHEN k % 6 <> 2 THEN k % 8 <> 1 END AS drill_passed,
      n_distinct <> samples AS duplicated, n_outside
    FROM (SELECT policy_id, substr(policy_id, 4)::INT AS k, count(*) AS samples,
        count(DISTINCT sample_id // 2) AS n_distinct,
        count(*) FILTER (sample_id % 97 = 0) AS n_outside FROM observations GROUP BY 1)""")


def bundles(w):
    dup = calibration.duplicate_identities(
        w.observations.withColumn("identity", F.expr("sample_id div 2")), ["policy_id"], ["identity"])
    outside = w.observations.groupBy("policy_id").agg(
        F.count_if(F.expr("sample_id % 97 = 0")).alias("n_outside"))
    facts = dup.join(outside, "policy_id").withColumn("k", F.expr("cast(substr(policy_id, 4) AS INT)"))
    return facts.selectExpr(
        "policy_id", "duplicated", "n_outside",
        "element_at(array('draft', 'shadow', 'warning'), k % 3 + 1) AS from_mode",
        "element_at(array('shadow', 'warning', 'blocking'), (k + cast(k div 9 AS INT)) % 3 + 1) AS target_mode",
        "element_at(array('draft', 'shadow', 'warning'), k % 3 + 1) AS approval_from",
        "element_at(array('shadow', 'warning', 'blocking'), (k + cast(k div 9 AS INT)) % 3 + 1) AS approval_target",
        "concat('owner', k % 4 + k div 15) AS approval_owner",
        "timestamp_ntz'2024-01-01 00:00:00' AS window_start",
        "IF(k % 7 <> 3, timestamp_ntz'2024-01-09 00:00:00', timestamp_ntz'2023-12-09 00:00:00') AS approved_at",
        "IF(k % 6 <> 2, k % 8 <> 1, NULL) AS drill_passed",
        "concat('owner', k % 4) AS drill_owner", "timestamp_ntz'2024-01-08 00:00:00' AS drill_at")


def registry(w):
    return w.observations.select("policy_id").distinct().withColumn(
        "k", F.expr("cast(substr(policy_id, 4) AS INT)")).selectExpr(
        "policy_id", "element_at(array('draft', 'shadow', 'warning', 'blocking'), k % 4 + 1) AS mode",
        "IF(k % 5 = 0, 'medium', 'high') AS precision", "concat('owner', k % 4) AS owner")


def gates(w):
    return w.observations.select("policy_id").distinct().select(
        "policy_id", *[F.lit(v).alias(k) for k, v in calibration.GATES.items()])


def gate_report(w, unregistered="", ungated=""):
    """Gates of all bundles, one policy left out of the registry and one out of the gates."""
    return calibration.calibration_gates(
        calibration.calibration_report(w.observations), gates(w).where(F.col("policy_id") != ungated),
        bundles(w), registry(w).where(F.col("policy_id") != unregistered))


@query("calibration_gates", """
    SELECT policy_id, len(r) = 0 AS eligible, array_to_string(r, '; ') AS reasons
    FROM (SELECT policy_id, list_filter([
        CASE WHEN NOT registered THEN 'policy is not registered' END,
        CASE WHEN NOT gated THEN 'calibration gates are unavailable for policy' END,
        CASE WHEN registered AND mode <> from_mode THEN 'registry mode does not match bundle from_mode' END,
        CASE WHEN list_position(['draft','shadow','warning','blocking'], target_mode)
          <> list_position(['draft','shadow','warning','blocking'], from_mode) + 1
          THEN 'promotion must advance exactly one lifecycle stage' END,
        CASE WHEN registered AND target_mode = 'blocking' AND precision <> 'high'
          THEN 'blocking requires a high-precision deterministic validator' END,
        CASE WHEN registered AND approval_owner <> owner THEN 'owner approval is not bound to this exact promotion' END,
        CASE WHEN NOT approved_late THEN 'owner approval predates the calibration window' END,
        CASE WHEN target_mode = 'blocking' AND (drill_passed IS NOT TRUE OR NOT registered)
          THEN 'blocking requires a signed, current, successful rollback drill' END,
        CASE WHEN duplicated THEN 'calibration observations contain duplicates' END,
        CASE WHEN n_outside > 0 THEN 'calibration observation is outside the declared window' END,
        CASE WHEN gated AND samples < 30 THEN 'insufficient total calibration samples' END,
        CASE WHEN gated AND positives < 10 THEN 'insufficient positive calibration samples' END,
        CASE WHEN gated AND negatives < 10 THEN 'insufficient negative calibration samples' END,
        CASE WHEN gated AND false_positive_rate > 0.02 THEN 'false positive rate exceeds promotion gate' END,
        CASE WHEN gated AND false_negative_rate > 0.0 THEN 'false negative rate exceeds promotion gate' END,
        CASE WHEN gated AND unknown_rate > 0.05 THEN 'unknown rate exceeds promotion gate' END],
        lambda x: x IS NOT NULL) AS r
      FROM (SELECT *, policy_id <> 'src17' AS registered, policy_id <> 'src18' AS gated FROM bundles JOIN report USING (policy_id)))""", "bundles report")
def calibration_gates(w):
    return gate_report(w, "src17", "src18").select("policy_id", "eligible", F.array_join("reasons", "; ").alias("reasons"))


@query("duplicate_identity", """
    SELECT l_suppkey, count(*) AS n, count(DISTINCT (l_orderkey, l_partkey)) AS n_distinct,
      count(*) <> count(DISTINCT (l_orderkey, l_partkey)) AS duplicated FROM lineitem GROUP BY 1""")
def duplicate_identity(w):
    return calibration.duplicate_identities(w.table("lineitem"), ["l_suppkey"], ["l_orderkey", "l_partkey"])


@query("promotion_step", """
    SELECT policy_id, mode,
      CASE WHEN reason IS NULL THEN ['draft','shadow','warning','blocking'][rk + 1] ELSE mode END AS promoted,
      reason AS promotion_reason,
      CASE WHEN rk = 1 THEN mode ELSE ['draft','shadow','warning','blocking'][rk - 1] END AS rolled_back,
      CASE WHEN rk = 1 THEN 'draft policy cannot be rolled back' END AS rollback_reason
    FROM (SELECT policy_id, mode, list_position(['draft','shadow','warning','blocking'], mode) AS rk,
        CASE WHEN mode = 'blocking' THEN 'blocking policy cannot be promoted'
          WHEN samples < 50 THEN 'insufficient samples for promotion'
          WHEN false_positives / samples > 0.05 THEN 'false positive rate exceeds promotion gate' END AS reason
      FROM report JOIN bundles USING (policy_id))""", "report bundles")
def promotion_step(w):
    rows = calibration.calibration_report(w.observations).join(registry(w), "policy_id")
    up, up_reason = calibration.promotion_step(
        F.col("mode"), F.col("samples"), F.col("false_positives"), F.lit(50), F.lit(0.05))
    down, down_reason = calibration.rollback_step(F.col("mode"))
    return rows.select("policy_id", "mode", up.alias("promoted"), up_reason.alias("promotion_reason"),
                       down.alias("rolled_back"), down_reason.alias("rollback_reason"))


@query("cosign_count", """
    WITH acts AS (SELECT *, right(actor, 1)::INT AS k FROM approval_events),
      held AS (SELECT context_id, seq, actor AS approver, 'owner' || ((k + 1 + (seq // 3) % 2) % 4) AS delegate,
          lead(seq) OVER (PARTITION BY context_id, actor ORDER BY seq) AS until, min(seq) OVER (PARTITION BY context_id, actor) AS place
        FROM acts WHERE action IN ('delegate', 'add_evidence') AND k < 2),
      signed AS (SELECT context_id, seq, actor, k FROM acts WHERE action IN ('approve', 'request_evidence')),
      placed AS (SELECT s.context_id, s.seq, coalesce(arg_min(h.approver, (h.place, h.approver)), CASE WHEN any_value(s.k) < 2 THEN any_value(s.actor) END) AS slot
        FROM signed s LEFT JOIN held h ON h.context_id = s.context_id AND h.delegate = s.actor AND h.seq < s.seq AND (h.until IS NULL OR h.until >= s.seq)
        GROUP BY s.context_id, s.seq),
      firsts AS (SELECT context_id, slot, min(seq) AS seq FROM placed WHERE slot IS NOT NULL GROUP BY 1, 2),
      nth AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY seq) AS n FROM firsts)
    SELECT context_id, coalesce(slots, 0) AS slots, rejected, granted_seq IS NOT NULL AS granted, granted_seq
    FROM (SELECT context_id, count(*) FILTER (slot IS NULL) AS rejected FROM placed GROUP BY 1)
    LEFT JOIN (SELECT context_id, count(*) AS slots, max(seq) FILTER (n = 2) AS granted_seq FROM nth GROUP BY 1) USING (context_id)""",
       "approval_events")
def cosign_count(w):
    """Two owners must sign; evidence events re-delegate, to one of two others in turn, and requests sign, too."""
    events = w.approval_events
    approvers = events.select("context_id").distinct().withColumn(
        "approver", F.explode(F.array(F.lit("owner0"), F.lit("owner1"))))
    delegates = events.where("action IN ('delegate', 'add_evidence') AND actor IN ('owner0', 'owner1')").selectExpr(
        "context_id", "seq", "actor AS approver",
        "concat('owner', (cast(right(actor, 1) AS INT) + 1 + (seq div 3) % 2) % 4) AS delegate")
    signatures = events.where("action IN ('approve', 'request_evidence')")
    return approvals.cosign_counts(signatures, approvers, delegates, required=2)


DUP_EDGES_SQL = """SELECT 'CALLS:' || o_custkey || '->' || (o_orderkey % 50) AS edge_id,
    'c' || o_custkey AS source_id, 's' || (o_orderkey % 50) AS target_id, 'CALLS' AS kind,
    CASE WHEN o_orderkey % 9 = 0 THEN 'manual' ELSE 'AST' END AS source,
    'repo://orders/' || o_orderkey AS evidence_uri, o_orderkey AS seq FROM orders"""


@query("edge_dedupe", f"""
    SELECT edge_id, source_id, target_id, kind, source, evidence_uri,
      CASE WHEN source = 'manual' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence
    FROM ({DUP_EDGES_SQL}) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY seq) = 1""")
def edge_dedupe(w):
    rows = w.table("orders").selectExpr(
        "concat('CALLS:', o_custkey, '->', o_orderkey % 50) AS edge_id",
        "concat('c', o_custkey) AS source_id", "concat('s', o_orderkey % 50) AS target_id",
        "'CALLS' AS kind", "IF(o_orderkey % 9 = 0, 'manual', 'AST') AS source",
        "concat('repo://orders/', o_orderkey) AS evidence_uri", "o_orderkey AS seq")
    return metrics.edge_dedupe(rows, "seq")


@query("node_merge", """
    WITH facts AS (SELECT 'n' || o_custkey AS id, o_orderkey AS seq, o_orderstatus AS kind,
        o_orderpriority AS label, 'k' || (o_orderkey % 3) AS key, 'v' || (o_orderkey % 101) AS value FROM orders)
    SELECT f.id, f.kind, f.label, p.key, p.value
    FROM (SELECT id, arg_min(kind, seq) AS kind, arg_min(label, seq) AS label FROM facts GROUP BY 1) f
    LEFT JOIN (SELECT id, key, arg_max(value, seq) AS value FROM facts WHERE seq % 4 <> 0 GROUP BY 1, 2) p
      USING (id)""")
def node_merge(w):
    facts = w.table("orders").selectExpr(
        "concat('n', o_custkey) AS id", "o_orderkey AS seq", "o_orderstatus AS kind",
        "o_orderpriority AS label", "concat('k', o_orderkey % 3) AS key",
        "concat('v', o_orderkey % 101) AS value")
    return metrics.node_merge(facts, facts.where("seq % 4 <> 0"))


@query("edge_kind_coverage", "SELECT kind, source, count(*) AS n FROM edges GROUP BY ALL", "edges")
def edge_kind_coverage(w):
    return w.edges.groupBy("kind", "source").agg(F.count("*").alias("n"))


WORDS_SQL = ", ".join(
    f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT AS w{i}" for i in range(8))
FILE_HASH_SQL = "sha256(length(path) || ':' || path || ':' || sha256(content))"
DIGEST_SQL = "sha256(concat_ws(',', n_files, w0, w1, w2, w3, w4, w5, w6, w7))"
add_view("base_files", "", """SELECT source AS repo, 'kb/' || doc_id || '.md' AS path,
    text AS content, doc_id FROM documents""")


@query("content_digest", f"""
    SELECT repo, n_files, {DIGEST_SQL} AS digest FROM (SELECT repo, count(*) AS n_files, {WORDS_SQL}
      FROM (SELECT repo, {FILE_HASH_SQL} AS h FROM base_files) GROUP BY 1)""", "base_files")
def content_digest(w):
    return metrics.content_digests(base_files(w), ["repo"], "path", "content")


def base_files(w):
    return w.table("documents").selectExpr(
        "source AS repo", "concat('kb/', doc_id, '.md') AS path", "text AS content", "doc_id")


@query("call_order_check", """
    SELECT function_id, CASE WHEN NOT decorated THEN 'required transaction decorator is missing'
        WHEN NOT coalesce(has_arg, false) OR protected_line IS NULL THEN 'required guard call is missing'
        WHEN required_line >= protected_line THEN 'guard call does not precede the protected call'
        ELSE 'passed' END AS outcome
    FROM (SELECT l_orderkey AS function_id, l_orderkey % 5 <> 0 AS decorated,
        bool_or(l_quantity < 40) FILTER (l_linenumber % 3 = 0) AS has_arg,
        min(l_linenumber) FILTER (l_linenumber % 3 = 0) AS required_line,
        min(l_linenumber) FILTER (l_linenumber % 3 = 1) AS protected_line
      FROM lineitem GROUP BY ALL)""")
def call_order_check(w):
    from tidegate.operators.artifacts import call_order_check as check

    facts = w.table("lineitem").selectExpr(
        "l_orderkey AS function_id", "l_linenumber AS line",
        "element_at(array('self.IdempotencyStore.check', 'self.ledger.redeem', 'log'), "
        "l_linenumber % 3 + 1) AS call",
        "IF(l_quantity < 40, 'idempotency_key', 'other') AS first_argument",
        "IF(l_orderkey % 5 <> 0, 'transaction', 'cached') AS decorator")
    return check(facts, required="IdempotencyStore.check", argument="idempotency_key",
                 protected="ledger.redeem", decorator="transaction")
