"""Policy calibration: observed error rates, promotion gates and lifecycle steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.metrics import share

# Lifecycle order, the default promotion thresholds, and the reason texts below.
MODES = ("draft", "shadow", "warning", "blocking")
GATES = {
    "min_samples": 30,
    "min_positive_samples": 10,
    "min_negative_samples": 10,
    "max_false_positive_rate": 0.02,
    "max_false_negative_rate": 0.0,
    "max_unknown_rate": 0.05,
}
DEFINITION_FIELDS = (
    "validator", "scope", "severity", "owner", "required_tests", "file_patterns", "precision",
)
# File patterns of registries written before patterns were stored.
VALIDATOR_PATTERNS = {
    "proto_openapi": (
        "**/*.proto", "*.proto", "**/*.yaml", "*.yaml", "**/*.yml", "*.yml", "**/*.json", "*.json",
    ),
    "sql_transaction": ("**/*.sql", "*.sql"),
    "schema_version": ("**/*.avsc", "*.avsc", "**/*.schema", "*.schema"),
}


def mode_rank(mode: Column) -> Column:
    """1 for draft up to 4 for blocking."""
    return F.array_position(F.array(*[F.lit(m) for m in MODES]), mode)


def mode_at(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MODES]), rank.cast("int") - 1)


def calibration_report(observations: DataFrame) -> DataFrame:
    """Sample counts and error rates per policy; a null label counts as unknown."""
    wanted, fired = F.col("expected_violation"), F.col("policy_triggered")
    counts = observations.groupBy("policy_id").agg(
        F.count("*").alias("samples"),
        F.count_if(wanted).alias("positives"),
        F.count_if(~wanted).alias("negatives"),
        F.count_if(wanted.isNull()).alias("unknowns"),
        F.count_if(~wanted & fired).alias("false_positives"),
        F.count_if(wanted & ~fired).alias("false_negatives"),
    )
    return counts.select(
        "*",
        share(F.col("false_positives"), F.col("negatives")).alias("false_positive_rate"),
        share(F.col("false_negatives"), F.col("positives")).alias("false_negative_rate"),
        share(F.col("unknowns"), F.col("samples")).alias("unknown_rate"),
    )


def duplicate_identities(observations: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Whether a group repeats an identity, counted in two combinable steps."""
    counted = observations.groupBy(*keys, *identity).agg(F.count("*").alias("copies"))
    return counted.groupBy(*keys).agg(
        F.sum("copies").alias("n"), F.count("*").alias("n_distinct")
    ).withColumn("duplicated", F.col("n") != F.col("n_distinct"))


def outside_window(observations: DataFrame, bundles: DataFrame) -> DataFrame:
    """Mark observations outside the inclusive window of their bundle; without a bundle all are."""
    return observations.join(
        bundles.select("policy_id", "window_start", "window_end"), "policy_id", "left"
    ).withColumn(
        "inside", F.coalesce(F.col("observed_at").between(F.col("window_start"), F.col("window_end")), F.lit(False))
    )


def calibration_gates(report: DataFrame, gates: DataFrame, bundles: DataFrame, policies: DataFrame) -> DataFrame:
    """Reasons that stop a promotion; eligible when there are none.

    ``bundles`` carries the requested transition, approval and drill facts plus the
    duplicate and window flags of its observations.
    """
    known = policies.withColumn("registered", F.lit(True))
    gated = gates.withColumn("has_gates", F.lit(True))
    joined = bundles.join(known, "policy_id", "left").join(gated, "policy_id", "left").join(
        report, "policy_id", "left"
    ).fillna(0, [name for name in report.columns if name != "policy_id"])
    c = F.col
    to_blocking = c("target_mode") == "blocking"
    drill_ok = (
        F.coalesce(c("drill_passed"), F.lit(False))
        & (c("drill_owner") == c("owner"))
        & (c("drill_at") >= c("window_start"))
    )
    checks = [
        # a bundle without its policy or gates stays, and says so
        (c("registered").isNull(), "policy is not registered"),
        (c("has_gates").isNull(), "calibration gates are unavailable for policy"),
        (c("mode") != c("from_mode"), "registry mode does not match bundle from_mode"),
        (mode_rank(c("target_mode")) != mode_rank(c("from_mode")) + 1,
         "promotion must advance exactly one lifecycle stage"),
        (to_blocking & (c("precision") != "high"),
         "blocking requires a high-precision deterministic validator"),
        ((c("approval_from") != c("from_mode")) | (c("approval_target") != c("target_mode"))
         | (c("approval_owner") != c("owner")),
         "owner approval is not bound to this exact promotion"),
        (c("approved_at") < c("window_start"), "owner approval predates the calibration window"),
        (to_blocking & ~F.coalesce(drill_ok, F.lit(False)),
         "blocking requires a signed, current, successful rollback drill"),
        (c("duplicated"), "calibration observations contain duplicates"),
        (c("n_outside") > 0, "calibration observation is outside the declared window"),
        (c("samples") < c("min_samples"), "insufficient total calibration samples"),
        (c("positives") < c("min_positive_samples"), "insufficient positive calibration samples"),
        (c("negatives") < c("min_negative_samples"), "insufficient negative calibration samples"),
        (c("false_positive_rate") > c("max_false_positive_rate"),
         "false positive rate exceeds promotion gate"),
        (c("false_negative_rate") > c("max_false_negative_rate"),
         "false negative rate exceeds promotion gate"),
        (c("unknown_rate") > c("max_unknown_rate"), "unknown rate exceeds promotion gate"),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]))
    return joined.withColumn("reasons", reasons).withColumn(
        "eligible", F.size("reasons") == 0
    )


def promotion_step(mode: Column, samples: Column, false_positives: Column,
                   min_samples: Column, max_rate: Column) -> tuple[Column, Column]:
    """Next mode and refusal reason; a refused policy stays where it is."""
    reason = (
        F.when(mode == "blocking", "blocking policy cannot be promoted")
        .when(samples < min_samples, "insufficient samples for promotion")
        .when(F.try_divide(false_positives.cast("double"), samples) > max_rate,
              "false positive rate exceeds promotion gate")
    )
    return F.when(reason.isNull(), mode_at(mode_rank(mode) + 1)).otherwise(mode), reason


def rollback_step(mode: Column) -> tuple[Column, Column]:
    reason = F.when(mode == "draft", "draft policy cannot be rolled back")
    return F.when(reason.isNull(), mode_at(mode_rank(mode) - 1)).otherwise(mode), reason


def registry_diff(base: DataFrame, current: DataFrame, bundles: DataFrame) -> DataFrame:
    """Unsafe registry changes: one row per policy and reason.

    ``bundles`` has policy_id, eligible, from_mode and target_mode of the calibration
    evidence; a one-stage promotion needs an eligible bundle for exactly that step.
    """
    old = base.select("policy_id", F.struct("mode", *DEFINITION_FIELDS).alias("old"))
    new = current.select("policy_id", F.struct("mode", *DEFINITION_FIELDS).alias("new"))
    proof = bundles.select(
        "policy_id", F.struct("eligible", "from_mode", "target_mode").alias("proof")
    )
    joined = old.join(new, "policy_id", "full_outer").join(proof, "policy_id", "left")
    quiet = F.col("new.mode").isin("draft", "shadow")
    changed = F.lit(False)
    for field in DEFINITION_FIELDS:
        changed = changed | ~F.col(f"old.{field}").eqNullSafe(F.col(f"new.{field}"))
    added = F.col("old").isNull()
    removed = F.col("new").isNull()
    kept = ~added & ~removed
    step = mode_rank(F.col("new.mode")) - mode_rank(F.col("old.mode"))
    bound = (
        F.col("proof.eligible")
        & (F.col("proof.from_mode") == F.col("old.mode"))
        & (F.col("proof.target_mode") == F.col("new.mode"))
    )
    reasons = F.array_compact(F.array(
        F.when(removed, "registered policies cannot be deleted"),
        F.when(added & ~quiet, "new policy must start in draft or shadow"),
        F.when(kept & changed & ~quiet, "materially changed policy must return to shadow"),
        F.when(kept & (step > 1), "policy promotion must advance one stage"),
        F.when(kept & (step == 1) & F.col("proof").isNull(),
               "signed calibration bundle is missing"),
        F.when(kept & (step == 1) & ~bound, "policy calibration gate failed"),
    ))
    return joined.select("policy_id", F.explode(reasons).alias("reason"))


def registry_backfill(registry: DataFrame) -> DataFrame:
    """Fill missing file patterns from the validator; unknown validators are faults."""
    patterns = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, values in VALIDATOR_PATTERNS.items():
        patterns = patterns.when(
            F.col("validator") == name, F.array(*[F.lit(v) for v in values])
        )
    filled = registry.withColumn("file_patterns", F.coalesce(F.col("file_patterns"), patterns))
    return filled.withColumn(
        "fault", F.when(F.col("file_patterns").isNull(), "unknown validator")
    )
