"""SQL twins of the derived views, written for an independent engine."""

from __future__ import annotations

# Each view may read earlier views; ``needs`` names them.
VIEWS: dict[str, tuple[str, str]] = {
    "gdocs": ("", """
        SELECT doc_id AS id, source || ' ' || lang AS title, text AS content,
          CASE WHEN doc_id % 7 = 0 THEN 'global' ELSE source END AS scope,
          'team-' || lang AS owner,
          'repo://kb/' || source || '/' || doc_id || '.md' AS source_uri,
          CASE WHEN doc_id % 11 = 4 THEN 'r2' ELSE 'r1' END AS revision,
          0.5 + (doc_id % 50) / 100.0 AS confidence,
          CASE WHEN doc_id % 13 = 6 THEN TIMESTAMP '2020-01-01' END AS expires_at,
          CASE doc_id % 3 WHEN 0 THEN ['engineering'] WHEN 1 THEN ['engineering', 'merchant']
            ELSE ['security'] END AS acl,
          CASE WHEN doc_id % 20 = 3 THEN 'draft' WHEN doc_id % 20 = 5 THEN 'stale'
            ELSE 'published' END AS status,
          CASE WHEN doc_id % 4 = 1 THEN ['p' || (doc_id % 6)] ELSE [] END AS policy_ids
        FROM documents"""),
    "requests": ("", """
        SELECT item_id AS request_id, text AS query, 'src' || (item_id % 20) AS scope,
          CASE WHEN item_id % 2 = 0 THEN ['engineering'] ELSE ['security', 'merchant'] END AS roles,
          CASE WHEN item_id % 5 = 4 THEN 'r2' ELSE 'r1' END AS revision
        FROM benchmark"""),
    "attempts": ("gdocs requests", """
        SELECT g.*, r.request_id, r.scope AS req_scope, r.roles, r.revision AS req_revision
        FROM gdocs g JOIN requests r ON r.request_id = g.id % (SELECT count(*) FROM benchmark)"""),
    "policies": ("", """
        SELECT DISTINCT 'p' || (p_partkey % 6) AS policy_id,
          CASE WHEN p_partkey % 3 = 1 THEN 'critical' ELSE 'high' END AS severity
        FROM part"""),
    "findings": ("", """
        SELECT l_orderkey AS change_id,
          concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id,
          ['medium', 'high', 'critical', 'low'][l_linenumber % 4 + 1] AS severity,
          1.0::DOUBLE - l_tax AS confidence, l_returnflag = 'R' AS violated,
          l_quantity >= 49 AS critical_unknown,
          l_linestatus = 'O' AND l_discount >= 0.09::DOUBLE AS public_contract,
          ['draft', 'shadow', 'warning', 'blocking'][l_suppkey % 4 + 1] AS policy_mode,
          'owner' || (l_suppkey % 3) AS required_approver
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_tax) l_tax,
                max(l_returnflag) l_returnflag, max(l_quantity) l_quantity,
                max(l_linestatus) l_linestatus, max(l_discount) l_discount
              FROM lineitem GROUP BY ALL)"""),
    "changes": ("", """
        SELECT o_orderkey AS change_id, o_orderstatus <> 'P' OR o_custkey % 2 = 0 AS version_known,
          CASE WHEN o_orderpriority LIKE '1%' THEN true WHEN o_orderpriority LIKE '2%' THEN false
          END AS tests_passed, o_custkey % 5 = 0 AS approval_satisfied,
          'r' || (o_custkey % 2) AS revision
        FROM orders"""),
    "required": ("", """
        SELECT DISTINCT l_orderkey AS change_id, 't' || (l_partkey % 9) AS test_id
        FROM lineitem"""),
    "evidence": ("", """
        SELECT l_orderkey AS change_id, 't' || ((l_partkey + l_linenumber % 2) % 9) AS test_id,
          max('r' || (l_suppkey % 2)) AS revision, bool_and(l_returnflag <> 'R') AS passed
        FROM lineitem GROUP BY 1, 2"""),
    "predictions": ("", """
        SELECT task_id, truth,
          CASE WHEN task_id % 3 <> 0 THEN truth
            ELSE ['allow', 'tests', 'approval', 'block'][(task_id * 7 + ck) % 4 + 1] END AS prediction,
          impact
        FROM (SELECT o_orderkey AS task_id, o_custkey AS ck,
            CASE o_orderpriority[1] WHEN '1' THEN 'block' WHEN '2' THEN 'approval'
              WHEN '3' THEN 'tests' ELSE 'allow' END AS truth,
            o_orderkey % 2 = 0 AS impact FROM orders)"""),
    "metrics": ("", """
        SELECT event_id, ts, event_type AS decision, value AS duration_ms,
          event_id % 9 = 0 AS unknown, (event_id % 5)::INT AS shadow_findings FROM events"""),
    "approval_events": ("", """
        SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS context_id, event_id AS seq, ts,
          CASE event_type WHEN 'signup' THEN 'delegate' WHEN 'view' THEN 'request_evidence'
            WHEN 'click' THEN 'add_evidence' WHEN 'purchase' THEN 'approve' ELSE 'reject' END AS action,
          'owner' || (event_id % 4) AS actor, user_id
        FROM events"""),
    "observations": ("", """
        SELECT source AS policy_id, d.doc_id AS sample_id, toxic = 1 AS expected_violation,
          d.doc_id % 9 = 0 OR coalesce(toxic = 1 AND d.doc_id % 5 <> 0, false) AS policy_triggered
        FROM documents d
        LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)"""),
    "part_ids": ("", """
        SELECT *, 'repo://' || lower(replace(p_brand, '#', '-')) || '/part/' || p_partkey AS node,
          'repo://' || lower(replace(p_brand, '#', '-')) AS repo FROM part"""),
    "edges": ("part_ids", """
        SELECT *, kind || ':' || source_id || '->' || target_id AS edge_id, 'r1' AS revision,
          'repo://graph/' || kind || '/' || target_id AS evidence_uri
        FROM (
          SELECT node AS source_id, 'service://s' || l_suppkey AS target_id, 'MAPS_TO' AS kind,
            'AST' AS source, 0.9::DOUBLE AS confidence
          FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
          JOIN part_ids ON p_partkey = l_partkey WHERE p_size < 49
          UNION ALL SELECT repo, node, 'DECLARES', 'AST', 0.9 FROM part_ids
          UNION ALL SELECT 'service://s' || s_suppkey, 'db://nation/' || s_nationkey,
            'DEPLOYED_WITH', 'IDL', 0.9 FROM supplier
          UNION ALL SELECT 'db://nation/' || n_nationkey, 'capability://region-' || n_regionkey,
            'BELONGS_TO_CAPABILITY', 'manual', 1.0 FROM nation
          UNION ALL SELECT 'capability://region-' || r_regionkey, 'owner://team-' || (r_regionkey % 2),
            'OWNED_BY', 'manual', 1.0 FROM region)"""),
    "nodes": ("part_ids", """
        SELECT *, 'r1' AS revision FROM (
          SELECT node AS id, 'Code' AS kind, p_name AS label,
            p_size >= 49 AND p_type = 'ECONOMY' AS dynamic FROM part_ids
          UNION ALL SELECT DISTINCT repo, 'Organization', p_brand, false FROM part_ids
          UNION ALL SELECT 'service://s' || s_suppkey, 'Deployment', s_name, false FROM supplier
          UNION ALL SELECT 'db://nation/' || n_nationkey, 'Data', n_name, false FROM nation
          UNION ALL SELECT 'capability://region-' || r_regionkey, 'Business', r_name, false FROM region
          UNION ALL SELECT DISTINCT 'owner://team-' || (r_regionkey % 2), 'Organization',
            'team-' || (r_regionkey % 2), false FROM region)"""),
    "starts": ("part_ids", "SELECT node AS start FROM part_ids"),
    "diff_parts": ("", """
        SELECT *, 'docs/' || source || '/' || doc_id AS stem, len(ls) AS n,
          'docs/' || source || '/' || doc_id || CASE WHEN shape = 2 THEN '.md' ELSE '.' || ext END AS old_p,
          'docs/' || source || '/' || doc_id || '.' || ext AS new_p
        FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls,
            ['sql', 'proto', 'yaml', 'avsc', 'properties', 'java'][doc_id % 6 + 1] AS ext,
            doc_id % 10 AS shape, doc_id % 50 AS fault FROM documents)"""),
    "diffs": ("diff_parts", """
        SELECT doc_id AS change_id, concat_ws(chr(10),
            CASE WHEN fault <> 23 THEN 'diff --git a/' || old_p || ' b/' || new_p END,
            CASE WHEN shape = 2 AND fault <> 12 THEN 'rename from ' || old_p END,
            CASE WHEN shape = 2 THEN 'rename to ' || new_p END,
            CASE WHEN fault = 33 THEN 'GIT binary patch' END,
            CASE WHEN shape = 0 THEN '--- /dev/null' ELSE '--- a/' || old_p END,
            CASE WHEN fault = 43 THEN NULL WHEN shape = 1 THEN '+++ /dev/null'
              WHEN fault = 3 THEN '+++ b/../' || new_p ELSE '+++ b/' || new_p END,
            '@@ -' || CASE WHEN shape = 0 THEN '0,0'
              ELSE '1,' || (n + CASE WHEN fault = 13 THEN 1 ELSE 0 END) END
              || ' +' || CASE WHEN shape = 1 THEN '0,0' ELSE '1,' || n END || ' @@',
            CASE WHEN shape = 0 THEN array_to_string(list_transform(ls, lambda x: '+' || x), chr(10))
              WHEN shape = 1 THEN array_to_string(list_transform(ls, lambda x: '-' || x), chr(10))
              ELSE array_to_string(list_concat(['-' || ls[1], '+' || ls[1] || ' (changed)'],
                list_transform(ls[2:], lambda x: ' ' || x)), chr(10)) END) AS diff_text,
          CASE doc_id % 7
            WHEN 1 THEN array_to_string(list_concat([ls[1] || ' (changed)'], ls[2:]), chr(10))
            WHEN 2 THEN '# header' || chr(10) || '# moved' || chr(10) || text
            WHEN 3 THEN 'unrelated ' || stem ELSE text END AS stored_text
        FROM diff_parts"""),
}


def add_view(name: str, needs: str, sql: str) -> None:
    """Add a view for the queries of one module."""
    VIEWS[name] = (needs, sql)


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the views it reads, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dependency in VIEWS[name][0].split():
            visit(dependency)
        ordered.append(name)

    for name in names:
        visit(name)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE"):] if recursive else body[len("WITH"):]
        prefix = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
        keyword = "WITH RECURSIVE " if recursive else "WITH "
        return keyword + (prefix + ",\n" if prefix else "") + rest.strip()
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered) + "\n" + body
