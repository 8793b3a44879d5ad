"""Governance filters and row rules; every one is a narrow transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import safety, text

# Fixed values of the artifact vocabulary.
CONTRACT_SUFFIXES = (".proto", ".yaml", ".yml", ".json")
OPENAPI_SUFFIXES = (".yaml", ".yml", ".json")
SCHEMA_SUFFIXES = (".avsc", ".schema")
CONFIG_SUFFIXES = (".properties", ".conf", ".env")
PUBLIC_MARKERS = ("openapi", "message ", "dto", "enum ", "record ")


def is_fresh(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at >= now)


def ineligible_reason(
    status: Column, expires_at: Column, revision: Column, scope: Column, acl: Column,
    *, now: Column, want_revision: Column, want_scope: Column, roles: Column,
) -> Column:
    """First failing governance rule in fixed order; null means eligible."""
    return (
        F.when((status == "stale") | ~is_fresh(expires_at, now), "stale")
        .when(status != "published", "status_not_published")
        .when(revision != want_revision, "revision_mismatch")
        .when((scope != "global") & (scope != want_scope), "scope_mismatch")
        .when(~F.arrays_overlap(acl, roles), "acl_denied")
    )


def ttl_stale(created: Column, now: Column, ttl_seconds: int, cached: Column, wanted: Column) -> Column:
    """Stale when older than the TTL or pinned to other revisions (maps as sorted entries)."""
    age = now.cast("timestamp").cast("double") - created.cast("timestamp").cast("double")

    def entries(column: Column) -> Column:
        return F.array_sort(F.map_entries(column))

    return (age > F.lit(float(ttl_seconds))) | (entries(cached) != entries(wanted))


def acl_subset(context_roles: Column, caller_roles: Column) -> Column:
    return F.size(F.array_except(context_roles, caller_roles)) == 0


def screen(rows: DataFrame, content: str) -> DataFrame:
    """Route instruction-like content to quarantine, keep the rest."""
    return rows.withColumn(
        "route", F.when(safety.is_injection(F.col(content)), "quarantine").otherwise("pass")
    )


def location_violation(folder: Column, status: Column) -> Column:
    return F.when(
        (folder == "candidates") & (status != "draft"),
        "knowledge/candidates only accepts draft entries",
    ).when(
        (folder == "published") & ~status.isin("published", "stale"),
        "knowledge/published only accepts owner-confirmed published entries",
    )


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a null condition counts as broken."""
    return F.array_compact(
        F.array(
            *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
        )
    )


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def artifact_kind(path: Column) -> Column:
    suffix = text.suffix(path)
    return (
        F.when(suffix.isin(*OPENAPI_SUFFIXES), "openapi")
        .when(suffix.isin(*SCHEMA_SUFFIXES), "message-schema")
        .when(suffix.isin(*CONFIG_SUFFIXES), "configuration")
        .otherwise(suffix)
    )


def validator_for(path: Column) -> Column:
    suffix = text.suffix(path)
    return (
        F.when(suffix.isin(*CONTRACT_SUFFIXES), "proto_openapi")
        .when(suffix == ".sql", "sql_transaction")
        .when(suffix.isin(*SCHEMA_SUFFIXES), "schema_version")
        .when(suffix.isin(*CONFIG_SUFFIXES), "no_literal_credentials")
    )


def node_kind(identifier: Column) -> Column:
    return (
        F.when(identifier.startswith("mq://"), "Messaging")
        .when(identifier.startswith("db://"), "Data")
        .when(identifier.startswith("api://") | identifier.startswith("proto://"), "Interface")
        .otherwise("Code")
    )


def is_public_path(path: Column) -> Column:
    return F.coalesce(text.suffix(path).isin(*CONTRACT_SUFFIXES), F.lit(False))


def has_public_marker(added: Column) -> Column:
    lowered = F.lower(added)
    found = F.lit(False)
    for marker in PUBLIC_MARKERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def revision_pin(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """One status per request: rows at the pinned revision, or INDEX_LAG when none match."""
    counts = rows.groupBy(key, "revision").agg(F.count("*").alias("n_rows"))
    return requests.join(counts, [key, "revision"], "left").withColumn(
        "status", F.when(F.col("n_rows").isNull(), "INDEX_LAG").otherwise("OK")
    )


def unsafe_path(path: Column) -> Column:
    return (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def unsupported_legacy_path(path: Column, prefixes: tuple[str, ...]) -> Column:
    allowed = F.lit(False)
    for prefix in prefixes:
        allowed = allowed | path.startswith(prefix)
    return ~(allowed & path.endswith(".py"))


def content_rule(path: Column, source: Column) -> Column:
    """Suffix-gated content rules: credentials in configuration, versions in schemas."""
    suffix = text.suffix(path)
    return F.when(
        suffix.isin(*CONFIG_SUFFIXES) & safety.has_literal_credential(source),
        "configuration contains a literal credential",
    ).when(
        suffix.isin(*SCHEMA_SUFFIXES) & ~F.contains(F.lower(source), F.lit("version")),
        "message schema has no version",
    )


def evidence_from(edges: DataFrame, source: str) -> DataFrame:
    """Evidence of the edges one provider observed; the filter reaches the scan."""
    return edges.where(F.col("source") == source).select(
        F.concat(F.lit("edge:"), "edge_id").alias("evidence_id"), "source", "confidence",
        "revision", "evidence_uri",
    )
