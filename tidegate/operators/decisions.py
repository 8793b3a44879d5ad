"""Findings to one four-state decision per change.

Findings are reduced with commutative aggregates only (``bool_or``, ``max``, ``min``), so
Spark combines them before the shuffle and a change that owns a third of all findings
still reaches the reducer as one row per map task. Lists that can grow with the data
(evidence ids, approvers) are returned in long form, never as one array per change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the decision contract.
SEVERITY_WEIGHTS = {"low": 0.15, "medium": 0.35, "high": 0.65, "critical": 1.0}
DEFAULT_WEIGHT = 0.35
APPROVAL_THRESHOLD = 0.7
INACTIVE_MODES = ("draft", "shadow")
RATIONALES = {
    "critical": "critical policy violation",
    "unknown": "critical boundary or version is unknown",
    "tests": "required test evidence is missing",
    "warning": "warning policy requires approval",
    "public": "public contract or multiple owners",
    "risk": "risk score requires approval",
    "clear": "all hard conditions and test evidence satisfied",
}
STATES = {
    "critical": "BLOCK",
    "unknown": "REQUIRE_APPROVAL",
    "tests": "ALLOW_WITH_TESTS",
    "warning": "REQUIRE_APPROVAL",
    "public": "REQUIRE_APPROVAL",
    "risk": "REQUIRE_APPROVAL",
    "clear": "ALLOW",
}


def is_active(mode: str = "policy_mode") -> Column:
    """Draft and shadow policies never influence a decision."""
    return ~F.col(mode).isin(*INACTIVE_MODES)


def is_material() -> Column:
    return F.col("violated") | F.col("critical_unknown") | F.col("public_contract")


def severity_weight(severity: str = "severity") -> Column:
    weight = F.when(F.lit(False), F.lit(0.0))
    for name, value in SEVERITY_WEIGHTS.items():
        weight = weight.when(F.col(severity) == name, F.lit(value))
    return weight.otherwise(F.lit(DEFAULT_WEIGHT))


def branch_conditions() -> dict[str, Column]:
    """Which decision branch an active finding can trigger."""
    return {
        "critical": F.col("violated")
        & (F.col("severity") == "critical")
        & (F.col("policy_mode") == "blocking"),
        "unknown": F.col("critical_unknown"),
        "warning": F.col("violated") & (F.col("policy_mode") == "warning"),
        "public": F.col("public_contract"),
    }


def active_findings(findings: DataFrame) -> DataFrame:
    return findings.where(is_active())


def shadow_hits(findings: DataFrame) -> DataFrame:
    """Findings of inactive policies that would have mattered."""
    return findings.where(~is_active() & (F.col("violated") | F.col("critical_unknown")))


def risk_scores(findings: DataFrame) -> DataFrame:
    """Strongest material signal per change; 0 when nothing is material."""
    signal = F.when(is_material(), severity_weight() * F.col("confidence"))
    return (
        active_findings(findings)
        .groupBy("change_id")
        .agg(F.least(F.lit(1.0), F.coalesce(F.max(signal), F.lit(0.0))).alias("risk_score"))
    )


def roll_up(findings: DataFrame) -> DataFrame:
    """One row per change with every flag the decision needs."""
    signal = F.when(is_material(), severity_weight() * F.col("confidence"))
    flags = [F.bool_or(cond).alias(f"has_{name}") for name, cond in branch_conditions().items()]
    return (
        active_findings(findings)
        .groupBy("change_id")
        .agg(
            *flags,
            F.max(signal).alias("top_signal"),
            F.min("required_approver").alias("first_owner"),
            F.max("required_approver").alias("last_owner"),
        )
    )


def decide(
    changes: DataFrame,
    findings: DataFrame,
    required: DataFrame,
    threshold: float = APPROVAL_THRESHOLD,
) -> DataFrame:
    """Apply the ordered hard gates to every change.

    ``changes`` carries change_id, version_known, tests_passed (nullable) and
    approval_satisfied. An approval releases only the branches that ask for one.
    """
    needs_tests = required.groupBy("change_id").agg(F.lit(True).alias("needs_tests"))
    joined = changes.join(roll_up(findings), "change_id", "left").join(
        needs_tests, "change_id", "left"
    )

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    held = ~F.coalesce(F.col("approval_satisfied"), F.lit(False))
    risk = F.least(F.lit(1.0), F.coalesce(F.col("top_signal"), F.lit(0.0)))
    many_owners = F.coalesce(F.col("first_owner") != F.col("last_owner"), F.lit(False))
    branch = (
        F.when(flag("has_critical"), "critical")
        .when((flag("has_unknown") | ~flag("version_known")) & held, "unknown")
        .when(flag("needs_tests") & ~flag("tests_passed"), "tests")
        .when(flag("has_warning") & held, "warning")
        .when((flag("has_public") | many_owners) & held, "public")
        .when((risk >= threshold) & held, "risk")
        .otherwise("clear")
    )
    return joined.select(
        "change_id",
        branch.alias("branch"),
        F.round(risk, 6).alias("risk_score"),
    ).withColumns(
        {"decision": lookup("branch", STATES), "rationale": lookup("branch", RATIONALES)}
    )


def lookup(column: str, values: dict[str, object], default: object = None) -> Column:
    """Map a closed vocabulary to constants."""
    result = F.when(F.lit(False), F.lit(next(iter(values.values()))))
    for key, value in values.items():
        result = result.when(F.col(column) == key, F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))


def decision_references(
    decisions: DataFrame, findings: DataFrame, required: DataFrame
) -> DataFrame:
    """Long-form follow-up of each decision: evidence, tests, approvers, shadow hits.

    Evidence lists the findings of the branch that fired, tests appear only under
    ALLOW_WITH_TESTS and approvers only under REQUIRE_APPROVAL.
    """
    outcome = decisions.select("change_id", "branch", "decision")
    related = F.lit(False)
    for name, condition in branch_conditions().items():
        related = related | ((F.col("branch") == name) & condition)
    live = active_findings(findings).join(outcome, "change_id")
    evidence = live.where(related).select(
        "change_id", F.lit("evidence").alias("role"), F.col("finding_id").alias("ref")
    )
    approvers = approver_rows(findings).join(
        outcome.where(F.col("decision") == "REQUIRE_APPROVAL"), "change_id", "left_semi"
    ).select("change_id", F.lit("approver").alias("role"), F.col("approver").alias("ref"))
    tests = required.join(
        outcome.where(F.col("decision") == "ALLOW_WITH_TESTS"), "change_id", "left_semi"
    ).select("change_id", F.lit("test").alias("role"), F.col("test_id").alias("ref"))
    shadow = shadow_hits(findings).select(
        "change_id", F.lit("shadow").alias("role"), F.col("finding_id").alias("ref")
    )
    return evidence.unionByName(approvers).unionByName(tests).unionByName(shadow)


def approver_rows(findings: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Distinct owners plus approvers named by active findings, one row each."""
    named = active_findings(findings).where(F.col("required_approver").isNotNull()).select(
        "change_id", F.col("required_approver").alias("approver")
    )
    if owners is not None:
        named = named.unionByName(owners.select("change_id", "approver"))
    return named.distinct()


def next_actions(decisions: DataFrame) -> DataFrame:
    """One follow-up row per decision that needs one.

    Reads has_context, has_approvers and parsed next to the decision.
    """
    approval = F.col("decision") == "REQUIRE_APPROVAL"
    tool = (
        F.when(approval & ~F.col("has_context") & F.col("parsed"), "prepare_change")
        .when(approval & F.col("has_context") & F.col("has_approvers"), "request_approval")
        .when(F.col("decision") != "ALLOW", "none")
    )
    reason = (
        F.when(
            approval & ~F.col("has_context") & ~F.col("parsed"),
            "provide a valid unified diff before preparing a change context",
        )
        .when(
            approval & ~F.col("has_context"),
            "an approval must be bound to a persisted change context",
        )
        .when(
            approval & ~F.col("has_approvers"),
            "register a governed approver before creating an approval request",
        )
        .when(approval, F.col("rationale"))
        .when(
            F.col("decision") == "ALLOW_WITH_TESTS",
            "trusted CI must execute and attest the required tests",
        )
        .when(F.col("decision") == "BLOCK", "resolve blocking findings before retrying")
    )
    return decisions.select("*", tool.alias("tool"), reason.alias("reason")).where(
        F.col("tool").isNotNull()
    )


def gate_exit_code(decision: str = "decision") -> Column:
    """0 merges, 1 forbids the merge, 2 marks an unrecognised decision."""
    return (
        F.when(F.col(decision) == "ALLOW", 0)
        .when(F.col(decision).isin("ALLOW_WITH_TESTS", "REQUIRE_APPROVAL", "BLOCK"), 1)
        .otherwise(2)
    )


# Exit code, v2 state and priority of every legacy fault.
LEGACY_EXIT_CODES = {
    "input_validation": 2,
    "diff_parse": 3,
    "policy_uncovered": 4,
    "retrieval_empty": 5,
    "embedding_timeout": 6,
    "cache_corrupt": 7,
}
LEGACY_APPROVAL_FAULTS = (
    "policy_uncovered",
    "retrieval_empty",
    "embedding_timeout",
    "mcp_disconnected",
)
UNKNOWN_APPROVAL = ("INDEX_LAG", "REVISION_MISMATCH", "PERMISSION_DENIED", "DYNAMIC_BOUNDARY")


def legacy_exit_code(decision: str = "decision", fault: str = "fault") -> Column:
    return (
        F.when(F.col(decision) == "ALLOW", 0)
        .when(F.col(decision) == "BLOCK", 1)
        .otherwise(lookup(fault, LEGACY_EXIT_CODES, 3))
    )


def legacy_state(cards: DataFrame, faults: DataFrame) -> DataFrame:
    """Translate legacy cards; the most severe fault decides and nothing unknown is allowed.

    ``faults`` has card_id, seq and code. The earliest fault of the lowest priority wins,
    taken with ``min_by`` so that a card with many faults needs no sort.
    """
    priority = F.when(F.col("code").isin(*LEGACY_APPROVAL_FAULTS), 1).otherwise(0)
    worst = faults.groupBy("card_id").agg(
        F.min_by("code", F.struct(priority, F.col("seq"))).alias("fault")
    )
    state = (
        F.when(F.col("decision").isin("ALLOW", "BLOCK"), F.col("decision"))
        .when(F.col("fault").isin(*LEGACY_APPROVAL_FAULTS), "REQUIRE_APPROVAL")
        .otherwise("BLOCK")
    )
    return cards.join(worst, "card_id", "left").select("*", state.alias("state"))


def unknown_reason_state(reason: str = "reason") -> Column:
    """State for an incomplete check, conservative by default."""
    return (
        F.when(F.col(reason).isin(*UNKNOWN_APPROVAL), "REQUIRE_APPROVAL")
        .when(F.col(reason) == "TEST_EVIDENCE_MISSING", "ALLOW_WITH_TESTS")
        .otherwise("BLOCK")
    )


def test_evidence_gate(changes: DataFrame, required: DataFrame, evidence: DataFrame) -> DataFrame:
    """Tri-state test result per change; missing evidence is null, never success."""
    graded = required.join(
        evidence.select(
            "change_id", "test_id", F.col("revision").alias("evidence_revision"), "passed"
        ),
        ["change_id", "test_id"],
        "left",
    ).join(changes.select("change_id", "revision"), "change_id")
    rolled = graded.groupBy("change_id").agg(
        F.count_if(F.col("passed").isNull()).alias("missing"),
        F.bool_and(F.col("passed") & (F.col("evidence_revision") == F.col("revision"))).alias(
            "all_passed"
        ),
    )
    outcome = (
        F.when(F.col("missing").isNull(), F.lit(True))
        .when(F.col("tests_passed").isNotNull(), F.col("tests_passed"))
        .when(F.col("missing") > 0, F.lit(None).cast("boolean"))
        .otherwise(F.col("all_passed"))
    )
    return changes.join(rolled, "change_id", "left").select(
        "change_id", outcome.alias("tests_ok")
    )


def outcome_contradictions(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Decisions that contradict the findings they rest on."""
    flags = findings.groupBy("change_id").agg(
        F.bool_or(F.col("violated") | F.col("critical_unknown")).alias("failed"),
        F.bool_or("critical_unknown").alias("has_reason"),
        F.bool_or(F.col("violated") & (F.col("policy_mode") == "blocking")).alias("blocked"),
    )
    joined = decisions.join(flags, "change_id", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    problems = F.array_compact(
        F.array(
            F.when(
                (F.col("decision") == "ALLOW") & flag("failed"),
                "ALLOW decision contains a failed or incomplete finding",
            ),
            F.when(
                (F.col("decision") == "REQUIRE_APPROVAL") & ~flag("has_reason"),
                "REQUIRE_APPROVAL decision lacks an unknown reason",
            ),
            F.when(
                (F.col("decision") != "BLOCK") & flag("blocked"),
                "blocking violation but is not BLOCK",
            ),
        )
    )
    return joined.select("change_id", "decision", problems.alias("problems")).where(
        F.size("problems") > 0
    )
