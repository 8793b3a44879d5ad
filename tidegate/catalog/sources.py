"""Source and sink queries: data goes out through a sink and comes back through a reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import session
from tidegate.catalog.base import query
from tidegate.functions import safety
from tidegate.operators import metrics
from tidegate.sources import readers, sinks


@query("scan_front_matter", """
    SELECT id, owner, len(acl) AS n_acl, array_to_string(policy_ids, ',') AS policy_ids, md5(content) AS digest, fault FROM (
      SELECT CASE WHEN bad IN (0, 3, 4) THEN 'doc-' || doc_id END AS id, CASE WHEN bad NOT IN (1, 2) THEN 'team-' || lang END AS owner,
        CASE WHEN bad = 0 AND doc_id % 2 = 0 THEN ['engineering', 'ops'] WHEN bad = 0 THEN ['engineering'] END AS acl,
        CASE WHEN bad = 0 AND doc_id % 3 = 0 THEN ['p1', 'p2'] WHEN bad = 0 THEN [] END AS policy_ids,
        CASE WHEN bad NOT IN (1, 2) THEN regexp_replace(text, '^\\s+|\\s+\\z', '', 'g') END AS content,
        CASE bad WHEN 1 THEN 'knowledge must start with front matter' WHEN 2 THEN 'knowledge front matter is not closed'
          WHEN 3 THEN 'knowledge acl is not an inline list' WHEN 4 THEN 'knowledge confidence is not a number from 0 to 1'
          WHEN 5 THEN 'knowledge id is missing or malformed' END AS fault
      FROM (SELECT *, CASE doc_id % 40 WHEN 11 THEN 1 WHEN 12 THEN 2 WHEN 13 THEN 3 WHEN 14 THEN 4
        WHEN 15 THEN 5 ELSE 0 END AS bad FROM documents))""")
def scan_front_matter(w):
    texts = w.table("documents").selectExpr("""concat(IF(doc_id % 40 = 11, '', '---\\n'),
        IF(doc_id % 40 = 15, '', concat('id: doc-', doc_id, '\\n')), 'title: ', source, ': ', lang, '\\nowner: team-', lang,
        '\\nscope: ', source, '\\nsource_uri: repo://kb/', doc_id, '\\nsource_revision: r1\\nevidence_uri: repo://kb/', doc_id,
        CASE WHEN doc_id % 40 = 13 THEN '\\nacl:\\n  - security' WHEN doc_id % 2 = 0 THEN '\\nacl: [engineering, ops]' ELSE '' END,
        IF(doc_id % 3 = 0, '\\npolicy_ids: [p1, p2]', ''),
        IF(doc_id % 40 = 14, '\\nconfidence: high', '\\nconfidence: 0.9'), '\\nstatus: published', IF(doc_id % 40 = 12, '\\n', '\\n---\\n'), text) AS raw""")
    folder = session.scratch_dir(w.spark, "knowledge")
    readers.write_texts(texts, "raw", folder)
    rows = readers.front_matter(readers.read_texts(w.spark, folder, bundled=True))
    return rows.select("id", "owner", F.size("acl").cast("long").alias("n_acl"),
                       F.array_join("policy_ids", ",").alias("policy_ids"), F.md5("content").alias("digest"), "fault")


@query("scan_governed_files")
def scan_governed_files(w):
    folder = session.scratch_dir(w.spark, "repos")
    w.table("region").write.json(f"{folder}/core/contracts")
    w.table("nation").write.csv(f"{folder}/gateway/data")
    w.table("supplier").write.orc(f"{folder}/gateway/archive")
    files = readers.scan_files(w.spark, folder, (".json", ".csv"))
    return files.groupBy("repo", "suffix").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query("scan_registries", """SELECT 'policy-' || p_partkey AS id, p_type AS validator, p_brand AS owner, p_size % 4 AS n_tests
    FROM part""")
def scan_registries(w):
    rows = w.table("part").selectExpr(
        "concat('policy-', p_partkey) AS id", "p_type AS validator", "'s' AS scope", "'high' AS severity", "p_brand AS owner",
        "'fix' AS remediation", "slice(array('t1', 't2', 't3'), 1, p_size % 4) AS required_tests",
        "array('*.sql') AS file_patterns", "'draft' AS mode", "'high' AS precision")
    folder = session.scratch_dir(w.spark, "registry")
    rows.write.json(folder)
    return readers.read_registry(w.spark, "policies", folder).select(
        "id", "validator", "owner", F.size("required_tests").alias("n_tests"))


@query("scan_trace_json", """SELECT 'OBSERVED_CALL:u' || user_id || '->' || event_type AS edge_id, value AS confidence,
    'trace://day-' || strftime(ts, '%Y-%m-%d') || '-u' || user_id || '#' || event_id AS evidence_uri FROM events""")
def scan_trace_json(w):
    # a trace document holds a stretch of 64 event ids, so the busiest user of a day fills many
    documents = w.table("events").groupBy("user_id", F.to_date("ts").alias("day"), F.expr("event_id div 64")).agg(
        F.collect_list(F.struct(
            F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), "user_id").alias("source_id"),
            F.col("event_type").alias("target_id"), F.col("value").alias("confidence"),
            F.col("ts").cast("string").alias("first_seen"), F.col("ts").cast("string").alias("last_seen"))).alias("calls")
    ).selectExpr("concat('day-', day, '-u', user_id) AS document", "'r1' AS revision", "calls")
    folder = session.scratch_dir(w.spark, "traces")
    documents.write.json(folder)
    return readers.read_traces(w.spark, folder).select("edge_id", "confidence", "evidence_uri")


@query("scan_diff_text", """SELECT md5(diff_text) AS digest, len(string_split(diff_text, chr(10))) AS n_lines FROM diffs""", "diffs")
def scan_diff_text(w):
    folder = session.scratch_dir(w.spark, "diffs")
    readers.write_texts(w.diffs, "diff_text", folder)
    return readers.read_texts(w.spark, folder, bundled=True).select(
        F.md5("raw").alias("digest"), F.size(F.split("raw", "\n")).cast("long").alias("n_lines"))


@query("sink_snapshot", "SELECT edge_id, kind, confidence FROM edges WHERE kind <> 'DECLARES'", "edges")
def sink_snapshot(w):
    folder = session.scratch_dir(w.spark, "snapshots")
    # Two revisions share the folder; only one is read back.
    tagged = w.edges.withColumn("revision", F.when(F.col("kind") == "DECLARES", "r0").otherwise("r1"))
    sinks.write_snapshot(tagged, folder)
    return readers.read_snapshot(w.spark, folder, "r1").select("edge_id", "kind", "confidence")


@query("sink_put_if_absent", """
    WITH stored AS (SELECT o_orderkey AS id, o_orderstatus AS payload FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0),
      incoming AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS payload
        FROM orders WHERE o_custkey % 3 <> 0)
    SELECT id, payload, CASE WHEN s IS NULL THEN 'inserted' ELSE 'conflict' END AS outcome
    FROM (SELECT i.id, i.payload, s.payload AS s FROM incoming i LEFT JOIN stored s USING (id))
    WHERE s IS NULL OR s <> payload""")
def sink_put_if_absent(w):
    orders = w.table("orders")
    stored = orders.where("o_custkey % 2 = 0 OR o_custkey % 3 = 0").selectExpr("o_orderkey AS id", "o_orderstatus AS payload")
    incoming = orders.where("o_custkey % 3 <> 0").selectExpr(
        "o_orderkey AS id", "IF(o_custkey % 7 = 0, 'X', o_orderstatus) AS payload")
    inserts, conflicts = sinks.put_if_absent(stored, incoming.unionByName(incoming), "id", "payload")
    return inserts.withColumn("outcome", F.lit("inserted")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))


@query("sink_upsert_latest", """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def sink_upsert_latest(w):
    rows = w.table("events").select("user_id", "event_type", "event_id", "value")
    return sinks.upsert_latest(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"),
                               ["user_id", "event_type"], ["event_id"])


def audit_events(rows):
    return rows.selectExpr(
        "event_id", "event_type AS action", "concat('ctx-', user_id) AS change_context_id",
        "map('props', props, 'api_token', event_type, 'note', IF(event_id % 5 = 0, 'password: hunter2', 'fine')) AS details")


AUDIT_SQL = """SELECT event_id, event_type AS action, props, '[REDACTED]' AS api_token,
    CASE WHEN event_id % 5 = 0 THEN '[REDACTED]' ELSE 'fine' END AS note FROM events"""


def read_audit(w, folder):
    back = w.spark.read.schema("event_id BIGINT, action STRING, change_context_id STRING, details MAP<STRING, STRING>").json(folder)
    return back.selectExpr("event_id", "action", "details['props'] AS props", "details['api_token'] AS api_token",
                           "details['note'] AS note")


@query("sink_audit_append", AUDIT_SQL)
def sink_audit_append(w):
    folder = session.scratch_dir(w.spark, "audit")
    rows = audit_events(w.table("events"))
    sinks.append_audit(rows.where("event_id % 2 = 0"), folder)
    sinks.append_audit(rows.where("event_id % 2 = 1"), folder)
    return read_audit(w, folder)


@query("sink_metrics_report", """SELECT event_type AS decision, count(*) AS n, round(quantile_cont(value, 0.95)::DOUBLE, 6) AS p95
    FROM events GROUP BY 1""")
def sink_metrics_report(w):
    folder = session.scratch_dir(w.spark, "report")
    report = metrics.ops_metrics(w.metrics, ["decision"]).select("decision", "n", F.round("duration_ms_p95", 6).alias("p95"))
    sinks.write_report(report, folder)
    return w.spark.read.schema("decision STRING, n BIGINT, p95 DOUBLE").json(folder)
