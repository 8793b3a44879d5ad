"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import session
from tidegate.catalog.base import query
from tidegate.operators import approvals, calibration, joins, ordered
from tidegate.plans import jobs
from tidegate.sources import readers


def registry_globs(w):
    """Globs of the default policies, kept as a registry of JSON lines and read from it."""
    folder = session.scratch_dir(w.spark, "policies")
    w.spark.createDataFrame(jobs.POLICIES, readers.REGISTRY_SCHEMAS["policies"]).write.json(folder)
    return joins.policy_globs(readers.read_registry(w.spark, "policies", folder))


@query("required_tests", """
    SELECT DISTINCT r.capability, r.policy, t.test_id
    FROM (SELECT DISTINCT n_name AS capability, 'p' || (c_custkey % 3) AS policy, 'owner' || n_regionkey AS owner
        FROM customer JOIN nation ON n_nationkey = c_nationkey) r
    JOIN (SELECT n_name AS capability, 'p' || (s_suppkey % 3) AS policy, 'owner' || (s_suppkey % 5) AS owner,
        s_name AS test_id FROM supplier JOIN nation ON n_nationkey = s_nationkey) t
      USING (capability, policy, owner)""")
def required_tests(w):
    nation = w.table("nation")
    requests = w.table("customer").join(nation, F.expr("n_nationkey = c_nationkey")).selectExpr(
        "n_name AS capability", "concat('p', c_custkey % 3) AS policy").distinct()
    capabilities = nation.selectExpr("n_name AS capability", "concat('owner', n_regionkey) AS owner")
    tests = w.table("supplier").join(nation, F.expr("n_nationkey = s_nationkey")).selectExpr(
        "n_name AS capability", "concat('p', s_suppkey % 3) AS policy",
        "concat('owner', s_suppkey % 5) AS owner", "s_name AS test_id")
    return joins.required_tests(requests, capabilities, tests).select("capability", "policy", "test_id")


@query("contract_coverage", """
    WITH cov AS (SELECT DISTINCT l_orderkey AS change_id,
        unnest(['p' || (p_partkey % 6), 'q' || (p_size % 4)]) AS policy_id
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'ECONOMY')
    SELECT * FROM cov UNION ALL
    SELECT o_orderkey, 'policy_uncovered' FROM orders WHERE o_orderkey NOT IN (SELECT change_id FROM cov)""")
def contract_coverage(w):
    paths = w.table("lineitem").selectExpr("l_orderkey AS change_id", "concat('p/', l_partkey) AS path")
    contracts = w.table("part").where("p_type <> 'ECONOMY'").selectExpr(
        "concat('p/', p_partkey) AS source",
        "array(concat('p', p_partkey % 6), concat('q', p_size % 4)) AS policy_ids")
    coverage = joins.contract_coverage(paths, contracts)
    changes = w.table("orders").selectExpr("o_orderkey AS change_id")
    return coverage.unionByName(joins.uncovered_changes(changes, coverage).withColumn(
        "policy_id", F.lit("policy_uncovered")))


@query("call_resolution", """
    WITH calls AS (SELECT DISTINCT l_suppkey % 5 AS repo, l_partkey % 50 AS owner, l_linenumber % 9 AS container,
        l_orderkey % 7 AS receiver, l_orderkey % 9 AS name FROM lineitem),
      fields AS (SELECT p_partkey % 5 AS repo, p_partkey % 50 AS owner, p_size % 7 AS name,
        max(p_size % 50) AS type_name FROM part GROUP BY ALL),
      methods AS (SELECT o_orderkey % 5 AS repo, o_custkey % 50 AS owner, o_orderkey % 9 AS name,
        'n' || min(o_orderkey) AS node_id FROM orders GROUP BY ALL)
    SELECT DISTINCT s.node_id AS source_id, t.node_id AS target_id
    FROM calls c JOIN fields f ON (c.repo, c.owner, c.receiver) = (f.repo, f.owner, f.name)
    JOIN methods s ON (c.repo, c.owner, c.container) = (s.repo, s.owner, s.name)
    JOIN methods t ON (c.repo, f.type_name, c.name) = (t.repo, t.owner, t.name)""")
def call_resolution(w):
    calls = w.table("lineitem").selectExpr(
        "l_suppkey % 5 AS repo", "l_partkey % 50 AS owner",
        "cast(l_linenumber % 9 AS BIGINT) AS container", "l_orderkey % 7 AS receiver",
        "l_orderkey % 9 AS name")
    fields = w.table("part").selectExpr(
        "p_partkey % 5 AS repo", "p_partkey % 50 AS owner", "cast(p_size % 7 AS BIGINT) AS name",
        "cast(p_size % 50 AS BIGINT) AS t").groupBy("repo", "owner", "name").agg(
        F.max("t").alias("type_name"))
    methods = w.table("orders").selectExpr(
        "o_orderkey % 5 AS repo", "o_custkey % 50 AS owner", "o_orderkey % 9 AS name",
        "o_orderkey").groupBy("repo", "owner", "name").agg(
        F.concat(F.lit("n"), F.min("o_orderkey")).alias("node_id"))
    return joins.resolve_calls(calls, fields, methods)


@query("entity_field_semi", """
    SELECT 'field:' || c_custkey AS source_id, 'db://nation-' || c_nationkey || '/'
        || lower(c_mktsegment) || '_of' || c_custkey || '#account_balance' AS target_id,
      lower(c_mktsegment) || '_of' || c_custkey || '.account_balance' AS label
    FROM (SELECT c_custkey, c_nationkey, regexp_replace(lower(c_mktsegment), '^(.)(.*)$', '\\1\\2') AS c_mktsegment
      FROM customer)
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'O')""")
def entity_field_semi(w):
    fields = w.table("customer").selectExpr(
        "concat('nation-', c_nationkey) AS repo",
        "concat(initcap(lower(c_mktsegment)), 'Of', c_custkey) AS owner",
        "'accountBalance' AS name", "concat('field:', c_custkey) AS node_id")
    entities = w.table("orders").where("o_orderpriority LIKE '1%' AND o_orderstatus = 'O'").select(
        "o_custkey").distinct().join(w.table("customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "concat('nation-', c_nationkey) AS repo",
        "concat(initcap(lower(c_mktsegment)), 'Of', c_custkey) AS owner")
    return joins.entity_columns(fields, entities)


@query("unknown_reference_anti", """
    SELECT DISTINCT kind, ref_id FROM (
      SELECT 'registry' AS kind, l_partkey::VARCHAR AS ref_id FROM lineitem
      UNION ALL SELECT 'knowledge', doc_id::VARCHAR FROM labels) r
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE kind = 'registry' AND p_size > 10 AND p_partkey::VARCHAR = ref_id)
      AND NOT EXISTS (SELECT 1 FROM documents WHERE kind = 'knowledge' AND lang = 'en' AND doc_id::VARCHAR = ref_id)""")
def unknown_reference_anti(w):
    references = w.table("lineitem").selectExpr("concat('registry:', l_partkey) AS reference").unionByName(
        w.table("labels").selectExpr("concat('knowledge:', doc_id) AS reference")).unionByName(
        w.table("orders").selectExpr("concat('https:', o_orderkey) AS reference"))
    known = w.table("part").where("p_size > 10").selectExpr(
        "'registry' AS kind", "cast(p_partkey AS STRING) AS ref_id").unionByName(
        w.table("documents").where("lang = 'en'").selectExpr(
            "'knowledge' AS kind", "cast(doc_id AS STRING) AS ref_id"))
    return joins.unknown_references(references, known)


MODE_SQL = "['draft', 'shadow', 'warning', 'blocking']"
REGISTRY_SQL = f"""
    b AS (SELECT p_partkey, {MODE_SQL}[p_size % 4 + 1] AS mode, p_size % 4 + 1 AS rk, p_brand AS owner
      FROM part WHERE p_partkey % 50 <> 9),
    c AS (SELECT p_partkey, {MODE_SQL}[least(p_size % 4 + p_partkey % 3, 3) + 1] AS mode,
        least(p_size % 4 + p_partkey % 3, 3) + 1 AS rk,
        CASE WHEN p_partkey % 10 = 4 THEN 'moved' ELSE p_brand END AS owner FROM part WHERE p_partkey % 50 <> 7),
    j AS (SELECT coalesce(b.p_partkey, c.p_partkey) AS id, b.mode AS old, c.mode AS new, b.rk AS r0, c.rk AS r1,
        b.owner <> c.owner AS changed FROM b FULL JOIN c ON b.p_partkey = c.p_partkey)"""


def registry_versions(w):
    fixed = ["'v' AS validator", "'s' AS scope", "p_type AS severity", "array('t1') AS required_tests",
             "array('*.sql') AS file_patterns", "'high' AS precision"]
    modes = "element_at(array('draft', 'shadow', 'warning', 'blocking'), cast({} AS INT) + 1) AS mode"
    part = w.table("part")
    base = part.where("p_partkey % 50 <> 9").selectExpr(
        "p_partkey AS policy_id", modes.format("p_size % 4"), "p_brand AS owner", *fixed)
    current = part.where("p_partkey % 50 <> 7").selectExpr(
        "p_partkey AS policy_id", modes.format("least(p_size % 4 + p_partkey % 3, 3)"),
        "IF(p_partkey % 10 = 4, 'moved', p_brand) AS owner", *fixed)
    bundles = part.where("p_partkey % 4 <> 1").selectExpr(
        "p_partkey AS policy_id", "p_partkey % 8 <> 2 AS eligible",
        modes.format("p_size % 4").replace("AS mode", "AS from_mode"),
        modes.format("least(p_size % 4 + 1, 3)").replace("AS mode", "AS target_mode"))
    return base, current, bundles


@query("registry_diff", f"""
    WITH {REGISTRY_SQL}
    SELECT id AS policy_id, reason FROM (
      SELECT id, 'registered policies cannot be deleted' AS reason FROM j WHERE new IS NULL
      UNION ALL SELECT id, 'new policy must start in draft or shadow' FROM j WHERE old IS NULL AND r1 > 2
      UNION ALL SELECT id, 'materially changed policy must return to shadow' FROM j WHERE changed AND r1 > 2
      UNION ALL SELECT id, 'policy promotion must advance one stage' FROM j WHERE r1 > r0 + 1
      UNION ALL SELECT id, 'signed calibration bundle is missing' FROM j WHERE r1 = r0 + 1 AND id % 4 = 1
      UNION ALL SELECT id, 'policy calibration gate failed' FROM j WHERE r1 = r0 + 1 AND id % 8 = 2)""")
def registry_diff(w):
    return calibration.registry_diff(*registry_versions(w))


@query("registry_backfill", """
    SELECT p_partkey, len(pats) AS n_patterns, pats[1] AS first_pattern,
      CASE WHEN pats IS NULL THEN 'unknown validator' END AS fault
    FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN [p_name] ELSE
        CASE p_partkey % 4 WHEN 0 THEN ['**/*.proto', '*.proto', '**/*.yaml', '*.yaml', '**/*.yml', '*.yml',
            '**/*.json', '*.json']
          WHEN 1 THEN ['**/*.sql', '*.sql'] WHEN 2 THEN ['**/*.avsc', '*.avsc', '**/*.schema', '*.schema'] END
        END AS pats FROM part)""")
def registry_backfill(w):
    rows = w.table("part").selectExpr(
        "p_partkey", "element_at(array('proto_openapi', 'sql_transaction', 'schema_version', 'other'), "
        "cast(p_partkey % 4 AS INT) + 1) AS validator", "IF(p_size > 40, array(p_name), NULL) AS file_patterns")
    return calibration.registry_backfill(rows).select(
        "p_partkey", F.when(F.col("file_patterns").isNotNull(), F.size("file_patterns")).cast("long")
        .alias("n_patterns"), F.get("file_patterns", F.lit(0)).alias("first_pattern"), "fault")


@query("truth_join", """
    SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'missing truth' END AS fault
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""")
def truth_join(w):
    truth = w.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return w.table("documents").select("doc_id").join(truth, "doc_id", "left").withColumn(
        "fault", F.when(F.col("quality").isNull(), "missing truth"))


@query("policy_glob_join", """
    SELECT page_id, policy FROM (SELECT page_id, path, unnest(['ledger', 'contract', 'schema']) AS policy FROM (
      SELECT page_id, url || ['.sql', '.proto', '.yml', '.avsc', '.SQL', '.java'][page_id % 6 + 1] AS path FROM pages))
    WHERE (policy = 'ledger' AND path GLOB '*.sql') OR (policy = 'contract' AND
        (path GLOB '*.proto' OR path GLOB '*.yaml' OR path GLOB '*.yml' OR path GLOB '*.json'))
      OR (policy = 'schema' AND (path GLOB '*.avsc' OR path GLOB '*.schema'))""")
def policy_glob_join(w):
    rows = w.table("pages").selectExpr("page_id", "concat(url, element_at(array('.sql', '.proto', '.yml', "
                                       "'.avsc', '.SQL', '.java'), cast(page_id % 6 AS INT) + 1)) AS path")
    matched = joins.matching_policies(rows, registry_globs(w))
    return rows.join(matched, "path").select("page_id", F.col("policy_id").alias("policy"))


@query("term_containment_rank", """
    SELECT request_id, id, count(*) AS hits
    FROM (SELECT DISTINCT n_nationkey AS request_id, unnest(
        ['ring', 'red', 'b', 'small', n_name[-1], 'widget ' || (n_nationkey % 7)]) AS term FROM nation)
    JOIN (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 7) AS text FROM part) ON contains(text, term)
    GROUP BY ALL""")
def term_containment_rank(w):
    requests = w.table("nation").selectExpr(
        "n_nationkey AS request_id", "array('ring', 'red', 'b', 'small', right(n_name, 1), "
        "concat('widget ', n_nationkey % 7)) AS terms")
    texts = w.table("part").selectExpr("p_partkey AS id", "concat(p_name, ' ', p_partkey % 7) AS text")
    return joins.term_containment(requests, texts)


@query("window_membership", """
    SELECT event_id, event_type AS policy_id, ts BETWEEN a AND b AS inside
    FROM events JOIN (SELECT event_type, min(ts) + INTERVAL 2 DAY AS a, max(ts) - INTERVAL 3 DAY AS b
      FROM events GROUP BY 1) USING (event_type)""")
def window_membership(w):
    events = w.table("events").selectExpr("event_id", "event_type AS policy_id", "ts AS observed_at")
    bundles = events.groupBy("policy_id").agg(
        F.expr("min(observed_at) + INTERVAL 2 DAY").alias("window_start"),
        F.expr("max(observed_at) - INTERVAL 3 DAY").alias("window_end"))
    return calibration.outside_window(events, bundles).select("event_id", "policy_id", "inside")


@query("approval_coverage", """
    WITH latest AS (SELECT context_id, arg_max(event_id, event_id) AS id FROM (
        SELECT user_id AS context_id, event_id FROM events) GROUP BY 1),
      rec AS (SELECT context_id, id, 'f' || (id % 9 = 0)::INT AS stored,
        CASE WHEN id % 4 = 0 THEN ['owner0'] ELSE ['owner0', 'owner1', 'owner2'] END AS approvers,
        CASE id % 3 WHEN 0 THEN ['owner0', 'owner1'] WHEN 1 THEN ['owner0'] ELSE [] END AS approvals,
        CASE WHEN id % 5 = 0 THEN 3 ELSE 1 END AS cosigns,
        ['approved', 'pending', 'approved', 'escalated'][id % 4 + 1] AS state,
        CASE id % 7 WHEN 1 THEN TIMESTAMP '2024-03-01' WHEN 2 THEN TIMESTAMP '2024-01-01' END AS waiver FROM latest),
      ctx AS (SELECT c_custkey AS context_id, CASE c_custkey % 2 WHEN 0 THEN ['owner0'] ELSE ['owner0', 'owner1'] END
        AS required FROM customer),
      graded AS (SELECT ctx.context_id, CASE WHEN id IS NULL THEN NULL WHEN stored <> 'f0' THEN 'fingerprint_mismatch'
        WHEN NOT list_has_all(approvers, required) OR (state = 'approved' AND NOT list_has_all(approvals, required))
          THEN 'approver_mismatch'
        WHEN state = 'approved' AND len(approvals) < cosigns THEN 'cosign_mismatch'
        WHEN waiver > TIMESTAMP '2024-02-01' THEN 'waived'
        WHEN waiver IS NOT NULL AND state <> 'approved' THEN 'expired' ELSE state END AS approval_state
      FROM ctx LEFT JOIN rec USING (context_id))
    SELECT context_id, approval_state, coalesce(approval_state IN ('waived', 'approved'), false) AS satisfied
    FROM graded""")
def approval_coverage(w):
    latest = ordered.latest(w.table("events").withColumnRenamed("user_id", "context_id"),
                            ["context_id"], ["event_id"], ["event_id"])
    records = latest.selectExpr(
        "context_id", "concat('f', cast(event_id % 9 = 0 AS INT)) AS fingerprint",
        "IF(event_id % 4 = 0, array('owner0'), array('owner0', 'owner1', 'owner2')) AS approvers",
        "CASE event_id % 3 WHEN 0 THEN array('owner0', 'owner1') WHEN 1 THEN array('owner0') "
        "ELSE array() END AS approvals", "IF(event_id % 5 = 0, 3, 1) AS required_cosigns",
        "element_at(array('approved', 'pending', 'approved', 'escalated'), cast(event_id % 4 AS INT) + 1) AS state",
        "CASE event_id % 7 WHEN 1 THEN timestamp_ntz'2024-03-01 00:00:00' "
        "WHEN 2 THEN timestamp_ntz'2024-01-01 00:00:00' END AS waiver_expires_at")
    changes = w.table("customer").selectExpr(
        "c_custkey AS context_id", "'f0' AS fingerprint",
        "IF(c_custkey % 2 = 0, array('owner0'), array('owner0', 'owner1')) AS required")
    return approvals.approval_coverage(changes, records, F.expr("timestamp_ntz'2024-02-01 00:00:00'"))


@query("symbol_explain", """
    SELECT DISTINCT id, n.kind, label, evidence_uri FROM nodes n JOIN (
      SELECT source_id AS id, evidence_uri FROM edges UNION ALL SELECT target_id, evidence_uri FROM edges)
    USING (id)""", "nodes edges")
def symbol_explain(w):
    return joins.symbol_evidence(w.nodes, w.edges)


@query("business_overlay", """
    WITH chosen AS (SELECT r_regionkey, 'capability://region-' || r_regionkey AS cap FROM region WHERE r_regionkey <> 2)
    SELECT 'service://' || s_suppkey AS source_id, cap AS target_id, 'BELONGS_TO_CAPABILITY' AS kind
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN chosen ON r_regionkey = n_regionkey WHERE s_acctbal > 0
    UNION ALL SELECT cap, 'owner://team-' || (r_regionkey % 2), 'OWNED_BY' FROM chosen
    UNION ALL SELECT 'invariant://' || n_nationkey, cap, 'BELONGS_TO_CAPABILITY'
      FROM nation JOIN chosen ON r_regionkey = n_regionkey
    UNION ALL SELECT cap, 'invariant://' || n_nationkey, 'PROTECTED_BY'
      FROM nation JOIN chosen ON r_regionkey = n_regionkey""")
def business_overlay(w):
    capabilities = w.table("region").selectExpr(
        "concat('capability://region-', r_regionkey) AS capability_id",
        "concat('owner://team-', r_regionkey % 2) AS owner_id", "r_regionkey <> 2 AS in_graph")
    members = w.table("supplier").join(w.table("nation"), F.expr("s_nationkey = n_nationkey")).selectExpr(
        "concat('capability://region-', n_regionkey) AS capability_id", "concat('service://', s_suppkey) AS service_id")
    services = w.table("supplier").where("s_acctbal > 0").selectExpr("concat('service://', s_suppkey) AS service_id")
    invariants = w.table("nation").selectExpr(
        "concat('invariant://', n_nationkey) AS invariant_id", "concat('capability://region-', n_regionkey) AS capability_id")
    return joins.business_overlay(capabilities, members, services, invariants)


@query("context_drift", """
    WITH prep AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_partkey % 2 = 0 THEN 'test' ELSE 'approver' END AS role,
        'i' || (l_partkey % 40) AS item FROM lineitem WHERE l_linenumber % 3 <> 0),
      disc AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_partkey % 2 = 0 THEN 'test' ELSE 'approver' END AS role,
        'i' || (l_partkey % 40) AS item FROM lineitem WHERE l_linenumber % 2 = 1 OR l_linenumber % 3 = 0),
      lost AS (SELECT DISTINCT id FROM prep WHERE role = 'test' AND item NOT IN (
        SELECT 'i' || (p_partkey % 40) FROM part WHERE p_partkey % 40 < 36))
    SELECT o_orderkey AS context_id, 'context:STALE_CONTEXT' AS finding FROM orders WHERE o_custkey % 10 = 0
    UNION ALL SELECT id, 'context:CONTEXT_DRIFT' FROM lost
    UNION ALL SELECT DISTINCT id, 'context:CONTEXT_EXPANDED' FROM (SELECT * FROM disc EXCEPT SELECT * FROM prep)
      WHERE id IN (SELECT id FROM prep) AND id NOT IN (SELECT id FROM lost)""")
def context_drift(w):
    rows = w.table("lineitem").selectExpr(
        "l_orderkey AS context_id", "IF(l_partkey % 2 = 0, 'test', 'approver') AS role",
        "concat('i', l_partkey % 40) AS item", "l_linenumber")
    prepared = rows.where("l_linenumber % 3 <> 0").drop("l_linenumber").distinct()
    discovered = rows.where("l_linenumber % 2 = 1 OR l_linenumber % 3 = 0").drop("l_linenumber")
    catalog = w.table("part").where("p_partkey % 40 < 36").selectExpr("concat('i', p_partkey % 40) AS item").distinct()
    contexts = w.table("orders").selectExpr(
        "o_orderkey AS context_id", "'a' AS prepared_digest", "IF(o_custkey % 10 = 0, 'b', 'a') AS current_digest")
    return joins.context_drift(contexts, prepared, discovered, catalog)


@query("resolve_base_path", """
    WITH files AS (SELECT 'fr/' || page_id AS path FROM pages WHERE page_id % 2 = 0
        UNION ALL SELECT 'app/en/' || page_id FROM pages WHERE page_id % 3 = 0),
      changed AS (SELECT page_id, ['app/fr/', 'x/root/fr/', 'fr/', 'x/app/en/'][page_id % 4 + 1] || page_id AS path
        FROM pages),
      cand AS (SELECT path, path AS candidate, 0 AS pri FROM changed
        UNION ALL SELECT path, regexp_extract(path, 'root/(.*)$', 1), 1 FROM changed WHERE path LIKE '%root/%'
        UNION ALL SELECT path, array_to_string(string_split(path, '/')[i:], '/'), i + 1
        FROM (SELECT path, unnest(range(1, 1 + len(string_split(path, '/')))) AS i FROM changed)
        WHERE string_split(path, '/')[i] IN ('fr', 'app'))
    SELECT path, arg_min(candidate, (missing, pri)) AS base_path, NOT arg_min(missing, (missing, pri)) AS found
    FROM (SELECT *, candidate NOT IN (SELECT path FROM files) AS missing FROM cand) GROUP BY 1""")
def resolve_base_path(w):
    pages = w.table("pages")
    files = pages.where("page_id % 2 = 0").selectExpr("concat('fr/', page_id) AS path").unionByName(
        pages.where("page_id % 3 = 0").selectExpr("concat('app/en/', page_id) AS path"))
    changed = pages.selectExpr("concat(element_at(array('app/fr/', 'x/root/fr/', 'fr/', 'x/app/en/'), "
                               "cast(page_id % 4 AS INT) + 1), page_id) AS path")
    repositories = files.selectExpr("split(path, '/')[0] AS repository").distinct()
    return joins.resolve_base_path(changed, files, "root", repositories)


@query("golden_diff", """
    SELECT case_id, key, value, actual FROM (
      SELECT o_orderkey AS case_id, unnest(['status', 'priority', 'tests[0]']) AS key,
        unnest([o_orderstatus, o_orderpriority, 't0']) AS value,
        unnest([CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END,
          CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END, 't0']) AS actual FROM orders)
    WHERE value IS DISTINCT FROM actual""")
def golden_diff(w):
    orders = w.table("orders")
    pairs = "stack(4, 'status', {0}, 'priority', {1}, 'tests[0]', 't0', 'tests[1]', {2}) AS (key, value)"
    expected = orders.selectExpr("o_orderkey AS case_id", pairs.format(
        "o_orderstatus", "o_orderpriority", "NULL")).where("value IS NOT NULL")
    actual = orders.selectExpr("o_orderkey AS case_id", pairs.format(
        "IF(o_custkey % 7 = 0, 'X', o_orderstatus)", "IF(o_custkey % 11 <> 0, o_orderpriority, NULL)", "'t1'"))
    return joins.golden_diff(expected, actual)
