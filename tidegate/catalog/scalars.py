"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query
from tidegate.functions import ids, safety, text
from tidegate.functions.fingerprints import decision_fingerprint

Q = "url_encode({0})"


@query("canonical_ids", """
    SELECT p_partkey, 'repo://' || url_encode(p_brand) || '/src/' || url_encode(p_name) || '.java#'
        || replace(replace(url_encode(p_type || '.run(A,B)'), '%28', '('), '%29', ')').replace('%2C', ',') AS repo,
      'api://' || url_encode(p_brand) || '/GET/' || url_encode(p_name) AS api,
      'proto://' || url_encode(p_brand) || '/' || url_encode(p_type) || '/' || url_encode(p_name) AS proto,
      'db://' || url_encode(p_brand) || '/' || url_encode(p_name) || '#' || url_encode(p_type) AS db,
      'mq://' || url_encode(p_brand) || '/' || url_encode(p_name) AS mq,
      url_encode(p_type) || '.' || url_encode(p_name) || '(' || url_encode(p_brand) || ',int)' AS symbol
    FROM part""")
def canonical_ids(w):
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    return w.table("part").select(
        "p_partkey",
        ids.repo_id(brand, F.concat(F.lit("src/"), name, F.lit(".java")),
                    F.concat(kind, F.lit(".run(A,B)"))).alias("repo"),
        ids.api_id(brand, F.lit("get"), F.concat(F.lit("/"), name)).alias("api"),
        ids.proto_id(brand, kind, name).alias("proto"),
        ids.db_id(brand, name, kind).alias("db"),
        ids.mq_id(brand, name).alias("mq"),
        ids.java_symbol(kind, name, F.array(brand, F.lit("int"))).alias("symbol"),
    )


@query("snake_case", """
    SELECT c_custkey, lower(left(x, 1) || regexp_replace(substr(x, 2), '([A-Z])', '_\\1', 'g')) AS snake
    FROM (SELECT c_custkey, replace(c_name, '#', '') || 'Of' || c_mktsegment AS x FROM customer)""")
def snake_case(w):
    name = F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("Of"), F.col("c_mktsegment"))
    return w.table("customer").select("c_custkey", text.snake_case(name).alias("snake"))


@query("identifier_terms")
def identifier_terms(w):
    return w.table("documents").select(
        "doc_id", F.array_join(F.array_sort(text.identifier_terms(F.col("text"))), " ").alias("terms"))


@query("lexical_tokens", """
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+') AS t FROM documents)""")
def lexical_tokens(w):
    tokens = w.table("documents").select("doc_id", text.lexical_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                         F.md5(F.array_join("t", " ")).alias("digest"))


PAIR_SQL = """SELECT d.doc_id, regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}_-]+') AS a,
    regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}_-]+') AS b
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"""


def token_pairs(w):
    docs = w.table("documents").select(
        "doc_id", w.item_of("doc_id").alias("item_id"), text.lexical_tokens(F.col("text")).alias("a"))
    items = w.table("benchmark").select("item_id", text.lexical_tokens(F.col("text")).alias("b"))
    return docs.join(items, "item_id")


@query("set_cosine", f"""
    SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE
      round(len(list_intersect(list_distinct(a), list_distinct(b)))
        / sqrt(len(list_distinct(a))::DOUBLE * len(list_distinct(b))), 6) END AS score
    FROM ({PAIR_SQL})""")
def set_cosine(w):
    return token_pairs(w).select(
        "doc_id", F.round(text.set_cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query("term_intersect", f"""
    SELECT doc_id, len(list_intersect(list_distinct(a), list_distinct(b))) AS shared FROM ({PAIR_SQL})""")
def term_intersect(w):
    return token_pairs(w).select(
        "doc_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


@query("chunk_text", """
    SELECT doc_id, i - 1 AS chunk_no, length(substr(body, 800 * (i - 1) + 1, 800)) AS n_chars,
      md5(substr(body, 800 * (i - 1) + 1, 800)) AS digest
    FROM (SELECT doc_id, body, unnest(range(1, 1 + ceil(length(body) / 800.0)::BIGINT)) AS i
      FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+\\z', '', 'g') AS body FROM documents))""")
def chunk_text(w):
    chunks = w.table("documents").select(
        "doc_id", F.posexplode(text.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
                         F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


UNIT_SQL = text.UNIT_PATTERN


@query("token_estimate", f"""
    SELECT doc_id, len(regexp_extract_all(to_json(text)::VARCHAR, '{UNIT_SQL}')) AS n_tokens
    FROM (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' 变更 "治理" _x1' ELSE '' END AS text
      FROM documents)""")
def token_estimate(w):
    rows = w.table("documents").selectExpr(
        "doc_id", "concat(text, CASE WHEN doc_id % 9 = 0 THEN ' 变更 \"治理\" _x1' ELSE '' END) AS text")
    return rows.select("doc_id", text.token_estimate(text.json_string(F.col("text"))).cast("long")
                       .alias("n_tokens"))


@query("redact_map", f"""
    SELECT doc_id, '[REDACTED]' AS api_key,
      md5(regexp_replace(regexp_replace(body, '{safety.SENSITIVE_ASSIGNMENT}', '[REDACTED]', 'g'),
        '{safety.SENSITIVE_TOKEN}', '[REDACTED]', 'g')) AS body, source AS origin
    FROM (SELECT doc_id, source, text || CASE WHEN doc_id % 8 = 0 THEN ' sk-abcdEFGH1234 Password: x9'
      ELSE '' END AS body FROM documents)""")
def redact_map(w):
    rows = w.table("documents").selectExpr(
        "doc_id", "map('api_key', source, 'body', concat(text, CASE WHEN doc_id % 8 = 0 "
        "THEN ' sk-abcdEFGH1234 Password: x9' ELSE '' END), 'origin', source) AS details"
    ).withColumn("safe", safety.redact_map(F.col("details")))
    return rows.selectExpr("doc_id", "safe['api_key'] AS api_key", "md5(safe['body']) AS body",
                           "safe['origin'] AS origin")


@query("waiver_active", """
    SELECT event_id, ts < TIMESTAMP '2024-01-04 12:00:00' AS waiver_active,
      event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-03 00:00:00' AS escalate FROM events""")
def waiver_active(w):
    from tidegate.operators.approvals import should_escalate, waiver_is_active

    rows = w.table("events").selectExpr(
        "event_id", "ts AS now", "timestamp_ntz'2024-01-04 12:00:00' AS expires_at",
        "timestamp_ntz'2024-01-03 00:00:00' AS deadline",
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'evidence_requested' "
        "WHEN 'error' THEN 'rejected' ELSE 'approved' END AS state")
    return rows.select("event_id", waiver_is_active(F.col("expires_at"), F.col("now")).alias("waiver_active"),
                       should_escalate(F.col("state"), F.col("deadline"), F.col("now")).alias("escalate"))


@query("fingerprint", """
    SELECT change_id, sha256('{"base_revisions_sha256": "' || sha256('{"core": "' || c.revision || '"}')
      || '", "diff_sha256": "' || sha256('change ' || change_id)
      || '", "knowledge_content_digest": "' || sha256('kb') || '", "policy_revision": "p1"'
      || ', "repository_content_digest": "' || sha256('repo')
      || '", "required_approvers": [' || coalesce(appr, '') || '], "required_tests": ['
      || coalesce(tests, '') || ']}') AS fingerprint
    FROM changes c
    LEFT JOIN (SELECT change_id, string_agg('"' || test_id || '"', ', ' ORDER BY test_id) AS tests
      FROM required GROUP BY 1) USING (change_id)
    LEFT JOIN (SELECT change_id, string_agg(DISTINCT '"' || required_approver || '"', ', '
        ORDER BY '"' || required_approver || '"') AS appr FROM findings
      WHERE policy_mode NOT IN ('draft', 'shadow') GROUP BY 1) USING (change_id)""",
       "changes required findings")
def fingerprint(w):
    from tidegate.operators.decisions import active_findings

    # Both sets are bounded by the test and owner registries.
    tests = w.required.groupBy("change_id").agg(F.collect_set("test_id").alias("tests"))
    approvers = active_findings(w.findings).groupBy("change_id").agg(
        F.collect_set("required_approver").alias("approvers"))
    rows = w.changes.join(tests, "change_id", "left").join(approvers, "change_id", "left")
    return rows.select("change_id", decision_fingerprint(
        diff=F.concat(F.lit("change "), "change_id"),
        revisions=F.create_map(F.lit("core"), F.col("revision")),
        repository_digest=F.sha2(F.lit("repo"), 256), knowledge_digest=F.sha2(F.lit("kb"), 256),
        policy_revision=F.lit("p1"), tests=F.col("tests"), approvers=F.col("approvers"),
    ).alias("fingerprint"))


@query("index_revision", """
    SELECT change_id, CASE change_id % 3 WHEN 0 THEN 'idx-' || revision WHEN 1 THEN
        substr(sha256('{"core": "' || revision || '", "gateway": "g1"}'), 1, 16)
        ELSE 'phase3-fixture-v1' END AS index_revision FROM changes""", "changes")
def index_revision_query(w):
    from tidegate.functions.fingerprints import index_revision

    rows = w.changes.selectExpr("change_id", """CASE change_id % 3
        WHEN 0 THEN map('core', revision, '__index__', concat('idx-', revision))
        WHEN 1 THEN map('gateway', 'g1', 'core', revision)
        ELSE map_filter(map('core', revision), (k, v) -> false) END AS revisions""")
    return rows.select("change_id", index_revision(F.col("revisions")).alias("index_revision"))
