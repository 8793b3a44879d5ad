"""End-to-end jobs: compositions of the operators, one logical plan each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.functions.fingerprints import decision_fingerprint, index_revision
from tidegate.operators import (
    approvals, artifacts, context, decisions, diffs, filters, graph, joins, metrics, retrieval, schemas, sets,
)
from tidegate.session import cut_lineage, passing, scratch_dir

# The default registry of artifact policies, API markers and effect texts.
POLICIES = [
    {"id": "ledger", "validator": "sql_transaction", "severity": "critical", "mode": "blocking", "precision": "high",
     "owner": "ledger-team", "required_tests": ["ledger-audit"], "file_patterns": ["**/*.sql", "*.sql"]},
    {"id": "contract", "validator": "proto_openapi", "severity": "high", "mode": "warning", "precision": "high",
     "owner": "contract-team", "required_tests": ["contract-compat"],
     "file_patterns": ["**/*.proto", "*.proto", "**/*.yaml", "*.yaml", "**/*.yml", "*.yml", "**/*.json", "*.json"]},
    {"id": "schema", "validator": "schema_version", "severity": "critical", "mode": "shadow", "precision": "high",
     "owner": "schema-team", "required_tests": ["schema-version"],
     "file_patterns": ["**/*.avsc", "*.avsc", "**/*.schema", "*.schema"]},
    {"id": "credentials", "validator": "no_literal_credentials", "severity": "critical", "mode": "blocking",
     "precision": "high", "owner": "security-team", "required_tests": [],
     "file_patterns": ["**/*.properties", "*.properties", "**/*.conf", "*.conf", "**/*.env", "*.env"]},
]
API_MARKERS = ("openapi", "swagger", "paths:", "components:", "definitions:")
SUPPORTED = {
    "proto_openapi": filters.CONTRACT_SUFFIXES,
    "sql_transaction": (".sql",),
    "schema_version": filters.SCHEMA_SUFFIXES,
    "no_literal_credentials": filters.CONFIG_SUFFIXES,
}


def _proto_violations(rows: DataFrame) -> DataFrame:
    """Schemas that lost or renumbered a field, or never had an id or status."""
    protos = rows.where(text.suffix(F.col("path")) == ".proto")
    now = artifacts.proto_fields(protos, "check_id", "source").select(
        "check_id", F.col("message").alias("schema"), "field", "number")
    compared = protos.where("baseline IS NOT NULL")
    before = artifacts.proto_fields(compared, "check_id", "baseline").select(
        "check_id", F.col("message").alias("schema"), "field", "number")
    # identifiers hold no such character
    keyed = F.concat_ws("\x1f", F.col("check_id").cast("string"), "schema")
    broken = sets.contract_breaks(
        before.withColumn("schema", keyed), now.withColumn("schema", keyed)
    ).select(F.substring_index("schema", "\x1f", 1).cast(rows.schema["check_id"].dataType).alias("check_id"))
    named = now.where(F.col("field").isin("id", "status")).select("check_id").distinct()
    fresh = (
        protos.where("baseline IS NULL")
        .where(F.contains(F.lower("source"), F.lit("message")))
        .join(named, "check_id", "left_anti")
        .select("check_id")
    )
    return broken.unionByName(fresh).distinct().withColumn(
        "effect", F.lit("published Proto required field missing"))


def _is_api_document() -> Column:
    either = F.lower(F.concat_ws("\n", "source", "baseline"))
    marked = reduce(lambda a, b: a | b, [F.contains(either, F.lit(m)) for m in API_MARKERS])
    return text.suffix(F.col("path")).isin(*filters.OPENAPI_SUFFIXES) & marked


def _unread_contract() -> Column:
    """API documents that are no JSON on one side or the other, YAML among them."""
    unread = schemas.unreadable(F.col("source")) | (F.col("baseline").isNotNull() & schemas.unreadable(F.col("baseline")))
    return (F.col("validator") == "proto_openapi") & _is_api_document() & unread


def _openapi_violations(rows: DataFrame) -> DataFrame:
    """JSON API documents that lost a property or require an undeclared one."""
    documents = rows.where(_is_api_document() & ~_unread_contract())
    now = schemas.property_paths(documents, "check_id", "source")
    before = schemas.property_paths(documents.where("baseline IS NOT NULL"), "check_id", "baseline")
    lost = before.join(now, ["check_id", "schema", "path"], "left_anti").select("check_id")
    missing = schemas.missing_required(documents, "check_id", "source").select("check_id")
    return lost.unionByName(missing).distinct().withColumn(
        "effect", F.lit("published OpenAPI field removed"))


def _proto_openapi(rows: DataFrame) -> DataFrame:
    return _proto_violations(rows).unionByName(_openapi_violations(rows))


def _sql_transaction(rows: DataFrame) -> DataFrame:
    return artifacts.unsafe_scripts(rows, "check_id", "source").withColumn(
        "effect", F.lit("migration write is not transactional"))


def _content(rows: DataFrame) -> DataFrame:
    return rows.select(
        "check_id", filters.content_rule(F.col("path"), F.col("source")).alias("effect")
    ).where("effect IS NOT NULL")


VALIDATORS = {
    "proto_openapi": _proto_openapi,
    "sql_transaction": _sql_transaction,
    "schema_version": _content,
    "no_literal_credentials": _content,
}


def validate(checks: DataFrame) -> DataFrame:
    """Run each check through its named validator.

    ``checks`` has check_id, validator, path, source and baseline. A validator that does not
    support the artifact, or cannot read it, is a fault and not a pass.
    """
    supported = reduce(
        lambda a, b: a | b,
        [
            (F.col("validator") == name) & text.suffix(F.col("path")).isin(*suffixes)
            for name, suffixes in SUPPORTED.items()
        ],
    )
    found = reduce(
        DataFrame.unionByName,
        [run(checks.where(supported & (F.col("validator") == name))) for name, run in VALIDATORS.items()],
    )
    # no text goes into the join
    read = checks.select(
        "check_id",
        F.when(~supported, F.concat(F.lit("validator "), "validator", F.lit(" does not support artifact: "), "path"))
        .when(_unread_contract(), F.concat(F.lit("contract document cannot be read: "), "path"))
        .alias("fault"),
    )
    return read.join(found, "check_id", "left").select(
        "check_id",
        F.col("effect").isNotNull().alias("violated"),
        F.coalesce("effect", F.lit("artifact is compatible")).alias("effect"),
        "fault",
    )


FINDING = [
    "change_id", "finding_id", "severity", "confidence", "violated", "critical_unknown",
    "public_contract", "policy_mode", "required_approver", "effect",
]
# Findings about a prepared context: severity, whether it is a critical unknown, effect.
CONTEXT_FINDINGS = {
    "context:STALE_CONTEXT": ("high", True, "prepared context sources no longer match current governed content"),
    "context:CONTEXT_DRIFT": ("high", True, "prepared context references governed tests that are no longer available"),
    "context:CONTEXT_EXPANDED": (
        "medium", False, "evaluation added governed tests or approvers without dropping prepared requirements"),
}
UNPARSED = "diff cannot be safely parsed"


def findings_of(rows: DataFrame, **values: Column | str | float | bool | None) -> DataFrame:
    """Findings with ``values`` over defaults that say nothing; strings stand for themselves."""
    defaults = {
        "severity": "high", "confidence": 1.0, "violated": False, "critical_unknown": False, "public_contract": False,
        "policy_mode": "blocking", "required_approver": None, "effect": "",
    }
    kinds = {"required_approver": "string"}
    columns = {
        name: value if isinstance(value, Column) else F.lit(value).cast(kinds.get(name, "string")) if value is None else F.lit(value)
        for name, value in {**defaults, **values}.items()
    }
    return rows.select("change_id", *[columns[name].alias(name) for name in FINDING[1:]])


def governed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files that a policy of the registry governs, each with its checks, which are as many as such policies."""
    policies = registry.select(
        F.col("id").alias("policy_id"), "validator", "severity", F.col("mode").alias("policy_mode"),
        F.col("owner").alias("required_approver"), "required_tests")
    checks = diffs.governed_sides(files, joins.policy_globs(registry)).join(policies, "policy_id").groupBy("change_id", "file_no").agg(
        F.collect_list(F.struct("path", "check", *policies.columns)).alias("checks"))
    return files.join(checks, ["change_id", "file_no"]).join(diffs.public_contract(files), ["change_id", "file_no"])


def file_findings(touched: DataFrame, hunks: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Findings of the registry's policies on every side of every file of ``governed_files``, and the tests that they ask for.

    A file whose stored text fits neither state, and an artifact that its validator cannot read, are critical
    unknowns. Texts are rebuilt in scratch that goes when findings and tests are written.
    """
    findings, tests = (scratch_dir(touched.sparkSession, name) for name in ("findings", "tests"))
    with passing(touched.sparkSession):
        held = cut_lineage(diffs.stored_files(touched, stored), codec="zstd")
        rebuilt = diffs.reconstruct(touched, hunks, held, ("checks", "public_contract"))
        checks = (
            rebuilt.drop("old_path", "new_path").withColumn("c", F.explode("checks")).select("*", "c.*").drop("c", "checks")
            .withColumns({
                # the four columns that tell checks apart; the free text stands last
                "check_id": F.concat_ws("|", "change_id", "file_no", "check", "policy_id"),
                "source": F.when(F.col("check") == "removed", F.lit("")).otherwise(F.col("after_text")),
                "baseline": F.when(F.col("check") != "after", F.col("before_text")),
            })
            .drop("before_text", "after_text")
        )
        owned = {name: F.col(name) for name in ("severity", "policy_mode", "required_approver")}
        incomplete = findings_of(
            checks.where("fault IS NOT NULL"), **{**owned, "severity": "high"}, critical_unknown=True, effect=F.col("fault"),
            finding_id=F.concat("policy_id", F.lit(":RECONSTRUCTION_INCOMPLETE")),
        ).distinct()
        ready = checks.where("fault IS NULL").drop("fault")
        verdicts = validate(ready.select("check_id", "validator", "path", "source", "baseline"))
        validated = findings_of(
            ready.join(verdicts, "check_id"), **owned, violated=F.col("violated"), critical_unknown=F.col("fault").isNotNull(),
            public_contract=F.col("public_contract"), effect=F.coalesce("fault", "effect"),
            finding_id=F.concat_ws(":", "policy_id", "check"),
        )
        asked = ready.where(decisions.is_active()).select("change_id", F.explode("required_tests").alias("test_id")).distinct()
        return {"findings": cut_lineage(validated.unionByName(incomplete), findings), "tests": cut_lineage(asked, tests)}


def impact_findings(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, graph_revision: str) -> DataFrame:
    """Changes whose symbol ends at an unknown boundary; the graph holds one revision."""
    pinned = symbols.where(F.col("revision") == graph_revision)
    starts = pinned.select(F.col("node_id").alias("start"), "revision").distinct()
    ends = graph.unknown_boundaries(starts, graph.impact_routes(edges, starts), nodes, graph_revision)
    known = pinned.join(ends.select(F.col("start").alias("node_id"), "reason"), "node_id")
    other = symbols.where(F.col("revision") != graph_revision).withColumn("reason", F.lit("NO_INDEXED_ROUTE"))
    return findings_of(
        known.unionByName(other, allowMissingColumns=True), critical_unknown=True, required_approver="platform-team",
        finding_id=F.concat_ws(":", F.lit("impact"), "reason", "node_id"),
        effect="cross-service impact path ends at an unknown boundary",
    )


def invariant_findings(facts: DataFrame, invariant: dict[str, str], finding_id: str) -> DataFrame:
    """Call-order findings over code facts: change_id, function_id, call, first_argument, line, decorator."""
    keyed = facts.withColumn("function_id", F.struct("change_id", "function_id"))
    checked = artifacts.call_order_check(keyed, **invariant).select(F.col("function_id.change_id").alias("change_id"), "outcome")
    broken = F.col("outcome") != "passed"
    return findings_of(
        checked, finding_id=finding_id, severity=F.when(broken, "critical").otherwise("medium"), violated=broken,
        effect=F.col("outcome"))


def assess_changes(
    changes: DataFrame, stored: DataFrame, registry: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame,
    catalog_tests: DataFrame, prepared: DataFrame | None = None, contexts: DataFrame | None = None,
    code_findings: DataFrame | None = None, graph_revision: str = "r1",
) -> dict[str, DataFrame]:
    """Diffs of any number of files to findings, first decisions and the fingerprint an approval is bound to.

    ``changes`` has change_id, diff_text, tests_passed, base_revisions (a map), policy_revision,
    context_id (null without a prepared context), repository_digest and knowledge_digest;
    ``stored`` has change_id, path and stored_text; ``registry`` is that of ``read_registry``.
    ``prepared`` (context_id, role, item) and ``contexts`` (context_id, prepared_digest,
    current_digest) tell what a context was prepared with, ``catalog_tests`` which tests (item)
    there are. A diff that cannot be parsed safely asks for approval at risk 0.
    """
    spark = changes.sparkSession
    names = ("brief", "broken", "files", "touched", "hunks", "symbols")
    kept = {name: scratch_dir(spark, name) for name in names}
    # diffs and their lines go when what follows from them is written, before any file is rebuilt
    with passing(spark):
        lines_of = scratch_dir(spark, "lines")
        with passing(spark):
            whole = cut_lineage(changes, codec="zstd")
            lines = cut_lineage(diffs.diff_lines(whole), lines_of, "zstd")
            broken = cut_lineage(diffs.diff_faults(whole, lines).select("change_id").distinct(), kept["broken"])
            brief = cut_lineage(whole.withColumn("diff_digest", F.sha2("diff_text", 256)).drop("diff_text"), kept["brief"])
            parsed = brief.join(broken, "change_id", "left_anti").withColumn("revision", index_revision(F.col("base_revisions")))
            sound = whole.select("change_id", "diff_text").join(broken, "change_id", "left_anti")
            symbols = cut_lineage(
                diffs.changed_symbols(sound, nodes).where("node_id IS NOT NULL").select("change_id", "node_id")
                .join(parsed.select("change_id", "revision"), "change_id"), kept["symbols"])
        files = cut_lineage(diffs.diff_files(lines).join(broken, "change_id", "left_anti"), kept["files"])
        touched = cut_lineage(governed_files(files, registry), kept["touched"])
        hunks = cut_lineage(
            diffs.file_hunks(lines.join(touched.select("change_id", "file_no"), ["change_id", "file_no"], "left_semi")), kept["hunks"], "zstd")
    checked = file_findings(touched, hunks, stored)
    found = [checked["findings"], impact_findings(symbols, nodes, edges, graph_revision)]
    if code_findings is not None:
        found.append(code_findings.join(broken, "change_id", "left_anti"))
    findings = cut_lineage(reduce(DataFrame.unionByName, found))
    required, owners = checked["tests"], None
    if prepared is not None:
        of_context = parsed.where("context_id IS NOT NULL").select("change_id", "context_id")
        mine = prepared.join(of_context, "context_id")
        named = mine.where("role = 'approver'").select("change_id", F.col("item").alias("approver")).distinct()
        known = mine.where("role = 'test'").join(catalog_tests.select("item"), "item", "left_semi").select(
            "change_id", F.col("item").alias("test_id"))
        required = required.unionByName(known).distinct()
        discovered = required.select("change_id", F.lit("test").alias("role"), F.col("test_id").alias("item")).unionByName(
            decisions.approver_rows(findings).select("change_id", F.lit("approver").alias("role"), F.col("approver").alias("item")))
        drift = joins.context_drift(
            contexts, prepared, discovered.join(of_context, "change_id").select("context_id", "role", "item"), catalog_tests)
        # context ids belong to one change each
        about = drift.join(of_context, "context_id")
        say = lambda at: decisions.lookup("finding", {k: v[at] for k, v in CONTEXT_FINDINGS.items()})
        findings = cut_lineage(findings.unionByName(findings_of(
            about, finding_id=F.col("finding"), severity=say(0), critical_unknown=say(1), effect=say(2))))
        owners = named
    required = cut_lineage(required)
    gated = parsed.join(
        decisions.test_evidence_gate(parsed.select("change_id", "tests_passed", "revision"), required, evidence), "change_id",
    ).select("change_id", F.lit(True).alias("version_known"), F.col("tests_ok").alias("tests_passed"))
    gated = cut_lineage(gated)
    approvers = cut_lineage(decisions.approver_rows(findings, owners))
    first = decisions.decide(gated.withColumn("approval_satisfied", F.lit(False)), findings, required)
    asked = approvers.join(first.where("decision = 'REQUIRE_APPROVAL'"), "change_id", "left_semi")
    # both sets are bounded by the test and owner registries
    bound = (
        brief.join(required.groupBy("change_id").agg(F.collect_set("test_id").alias("tests")), "change_id", "left")
        .join(asked.groupBy("change_id").agg(F.collect_set("approver").alias("required")), "change_id", "left")
    )
    fingerprint = decision_fingerprint(
        diff_digest=F.col("diff_digest"), revisions=F.col("base_revisions"), repository_digest=F.col("repository_digest"),
        knowledge_digest=F.col("knowledge_digest"), policy_revision=F.col("policy_revision"), tests=F.col("tests"),
        approvers=F.col("required"))
    empty = F.expr("cast(array() AS ARRAY<STRING>)")
    bound = cut_lineage(bound.select(
        "change_id", "context_id", "policy_revision", F.coalesce("required", empty).alias("required"),
        fingerprint.alias("fingerprint")))
    return {"findings": findings, "required": required, "gated": gated, "broken": broken, "bound": bound}


def settle_changes(assessed: dict[str, DataFrame], approvals_: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Decisions after the lookup of stored approvals, with the follow-up of each.

    ``approvals_`` has the latest record of each context and policy revision. Only one that is
    bound to the very fingerprint of the change releases it.
    """
    bound, broken = assessed["bound"], assessed["broken"]
    latest = approvals_.join(bound.select("context_id", "policy_revision").distinct(), ["context_id", "policy_revision"], "left_semi")
    covered = approvals.approval_coverage(
        bound.where("context_id IS NOT NULL").select("context_id", "fingerprint", "required"), latest, now)
    stated = bound.join(broken.withColumn("unparsed", F.lit(True)), "change_id", "left").join(covered, "context_id", "left")
    held = assessed["gated"].join(stated.select("change_id", F.col("satisfied").alias("approval_satisfied")), "change_id")
    decided = decisions.decide(held, assessed["findings"], assessed["required"])
    conservative = broken.select(
        "change_id", F.lit("unknown").alias("branch"), F.lit(0.0).alias("risk_score"),
        F.lit("REQUIRE_APPROVAL").alias("decision"), F.lit(UNPARSED).alias("rationale"))
    unparsed = F.coalesce("unparsed", F.lit(False))
    outcome = cut_lineage(decided.unionByName(conservative).join(stated, "change_id").select(
        "change_id", "branch", "risk_score", "decision", "rationale", "fingerprint",
        F.when(~unparsed, F.col("approval_state")).alias("approval_state"),
        F.col("context_id").isNotNull().alias("has_context"), (~unparsed).alias("parsed"),
        (F.size("required") > 0).alias("has_approvers")))
    faults = findings_of(broken, finding_id="fault:diff_parse", critical_unknown=True, effect=UNPARSED)
    return {
        "decisions": outcome.drop("has_context", "parsed", "has_approvers"),
        "findings": assessed["findings"].unionByName(faults),
        "required": assessed["required"],
        "actions": decisions.next_actions(outcome).select("change_id", "tool", "reason"),
    }


def legacy_cards(
    changes: DataFrame, lines: DataFrame, contracts: DataFrame, corpus: DataFrame, findings: DataFrame
) -> DataFrame:
    """Three-state cards in fixed order: parse, coverage, retrieval, checks.

    ``contracts`` has source path and policy_ids, ``findings`` has change_id and outcome
    (passed, violated, incomplete); incomplete beats violated.
    """
    broken = diffs.diff_faults(changes, lines).select("change_id").distinct().withColumn(
        "unparsed", F.lit(True))
    paths = diffs.diff_files(lines).select(
        "change_id", F.coalesce("new_path", "old_path").alias("path"))
    covered = paths.join(contracts.where(F.size("policy_ids") > 0).select("path"), "path", "left_semi").select(
        "change_id").distinct().withColumn("covered", F.lit(True))
    rolled = findings.groupBy("change_id").agg(
        F.bool_or(F.col("outcome") == "incomplete").alias("incomplete"),
        F.bool_or(F.col("outcome") == "violated").alias("violated"))
    available = corpus.agg((F.count("*") > 0).alias("ok")).scalar()
    joined = (
        changes.select("change_id").join(broken, "change_id", "left").join(covered, "change_id", "left")
        .join(rolled, "change_id", "left").withColumn("available", available)
    )

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    fault = (
        F.when(flag("unparsed"), "diff_parse")
        .when(~flag("covered"), "policy_uncovered")
        .when(~flag("available"), "retrieval_empty")
        .when(flag("incomplete"), "diff_parse")
    )
    return joined.select(
        "change_id", fault.alias("fault"),
        F.when(fault.isNotNull(), "CHECK_INCOMPLETE").when(flag("violated"), "BLOCK").otherwise("ALLOW").alias("decision"),
    )


def context_packs(
    tasks: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, policies: DataFrame,
    now, budget: int, limit: int,
) -> DataFrame:
    """Items of one context pack per task under a token budget.

    ``tasks`` has request_id, query, scope, roles, revision, repos and hints. Layers:
    mandatory policies, the candidate path, evidence of path and knowledge, rationale texts.
    """
    symbols = pack_symbols(tasks, nodes).where("symbol IS NOT NULL")
    routes = graph.impact_routes(edges, symbols.select(F.col("symbol").alias("start")))
    return context.token_budget(pack_items(tasks, symbols, routes, docs, policies, now, limit), F.lit(budget))


def pack_symbols(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pack_id, symbol, confidence, symbol_fault): the first candidate of each task, or why there is none."""
    found = context.symbol_candidates(
        tasks.select(F.col("request_id").alias("task_id"), F.col("query").alias("task"), "repos", "hints"), nodes)
    return cut_lineage(found.where("position = 1 OR fault IS NOT NULL").select(
        F.col("task_id").alias("pack_id"), "symbol", "confidence", F.col("fault").alias("symbol_fault")))


def pack_items(
    tasks: DataFrame, symbols: DataFrame, routes: DataFrame, docs: DataFrame, policies: DataFrame, now, limit: int
) -> DataFrame:
    """(pack_id, layer, rank, tokens) of everything that could stand in a pack."""
    primary = symbols.join(graph.primary_routes(routes), F.col("symbol") == F.col("start"), "left")
    found = cut_lineage(retrieval.hybrid_search(tasks, docs, now, limit)).join(
        docs.select("id", "title", "content", "source_uri", "confidence"), "id")
    obligations = retrieval.mandatory_policies(tasks, docs, policies, now)

    def item(rows, layer, rank, payload):
        return rows.select(
            F.col("pack_id"), F.lit(layer).alias("layer"), rank.cast("long").alias("rank"),
            text.token_estimate(payload).cast("long").alias("tokens"),
        )

    mandatory = item(
        obligations.withColumnRenamed("request_id", "pack_id"), "mandatory",
        F.expr("cast(substr(policy_id, 2) AS BIGINT)"), F.to_json(F.struct("policy_id")))
    structural = item(primary, "structural", F.lit(0), F.to_json(F.struct("symbol", F.col("nodes").alias("path"))))
    proofs = primary.where("edges IS NOT NULL").select("pack_id", F.posexplode("edges").alias("rank", "edge_id"))
    knowledge = found.withColumnRenamed("request_id", "pack_id")
    evidence = item(proofs, "evidence", F.col("rank"), F.to_json(F.struct("edge_id"))).unionByName(
        item(knowledge, "evidence", F.col("position") + 1000, F.to_json(F.struct("id", "source_uri", "confidence"))))
    rationale = item(knowledge, "rationale", F.col("position"), F.to_json(F.struct("id", "title", "content")))
    traces = item(knowledge, "expandable", F.col("position"), F.to_json(F.struct("id", "bm25", "vector", "rerank")))
    return reduce(DataFrame.unionByName, [mandatory, structural, evidence, rationale, traces])


def context_pack_facts(
    tasks: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, policies: DataFrame,
    now, budget: int, limit: int, graph_revision: str,
) -> DataFrame:
    """One row per task: symbol, confidence, recall of mandatory policies under the budget, stale, unknowns, fault.

    ``unknowns`` holds at most two reasons: no symbol matches, and the impact ends at a boundary. A
    pack is ``stale`` when its task asks for another revision than the graph holds. Without a
    mandatory policy the recall is 1.
    """
    symbols = pack_symbols(tasks, nodes)
    usable = symbols.where("symbol IS NOT NULL")
    starts = usable.select(F.col("symbol").alias("start"), F.lit(graph_revision).alias("revision")).distinct()
    routes = cut_lineage(graph.impact_routes(edges, starts))
    ends = graph.unknown_boundaries(starts, routes, nodes, graph_revision).select(F.col("start").alias("symbol"), "reason")
    items = cut_lineage(context.token_budget(pack_items(tasks, usable, routes, docs, policies, now, limit), F.lit(budget)))
    recall = context.retained_policy_recall(items)
    over = items.groupBy("pack_id").agg(F.max("fault").alias("budget_fault"))
    asked = tasks.select(F.col("request_id").alias("pack_id"), (F.col("revision") != graph_revision).alias("stale"))
    joined = (
        symbols.join(asked, "pack_id").join(ends, "symbol", "left").join(recall, "pack_id", "left").join(over, "pack_id", "left")
    )
    has = F.col("symbol").isNotNull()
    unknowns = F.array_compact(F.array(
        F.when(F.col("symbol").startswith("unknown://task/"), "NO_MATCHING_SYMBOL"),
        F.when(has & F.col("stale"), "NO_INDEXED_ROUTE").otherwise(F.col("reason")),
    ))
    return joined.select(
        "pack_id", "symbol", "confidence", F.coalesce("mandatory_policy_recall", F.lit(1.0)).alias("mandatory_policy_recall"),
        "stale", unknowns.alias("unknowns"), F.coalesce("symbol_fault", "budget_fault").alias("fault"),
    )




def ablation_report(predictions: DataFrame) -> DataFrame:
    """Quality of several predictors over the same tasks, one row each."""
    return metrics.gate_quality(predictions, ["predictor"])
