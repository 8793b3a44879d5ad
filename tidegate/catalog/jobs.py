"""End-to-end queries and the schema jobs they use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import ENTRIES, query
from tidegate.catalog.filters import now
from tidegate.catalog.joins import registry_versions
from tidegate.catalog.metrics import gate_report, rounded
from tidegate.catalog.oracle_views import add_view
from tidegate.operators import calibration, decisions, diffs, retrieval, schemas
from tidegate.plans import jobs
from tidegate.plans.views import REVISION, TOP_K
from tidegate.session import cut_lineage

SCHEMA_JSON = """concat('{"components": {"schemas": {"', p_type, p_partkey, '": {"required": ["id", "gone"], "properties": {
    "id": {"type": "string"}, "', replace(p_name, ' ', '_'), '": {"required": ["lost"], "properties": {"inner": {"items": {"properties":
    {"leaf": {}}}}}}, "bag": {"additionalProperties": {"properties": {"v": {}}}}},
    "allOf": [{"properties": {"mixed": {}}}, {"oneOf": [{"properties": {"deep": {}}}]}]}}},
    "paths": {"things": {"get": [{"schema": {"properties": {"inline": {}}}}]}},
    "definitions": {"Flat', p_size, '": {"properties": {"only": {}}}}}')"""


@query("json_paths", """
    SELECT p_partkey, unnest(list_concat(list_transform(['id', n, n || '/inner', n || '/inner/[]/leaf', 'bag', 'bag/{}/v',
        'mixed', 'deep'], lambda x: 'components/schemas/' || p_type || p_partkey || ':' || x),
      ['definitions/Flat' || p_size || ':only', 'paths/things/get/0/schema:inline'])) AS path
    FROM (SELECT *, replace(p_name, ' ', '_') AS n FROM part)""")
def json_paths(w):
    documents = w.table("part").selectExpr("p_partkey", f"{SCHEMA_JSON} AS source")
    return schemas.property_paths(documents, "p_partkey", "source").select(
        "p_partkey", F.concat_ws(":", "schema", "path").alias("path"))


@query("missing_required", """SELECT p_partkey, 'components/schemas/' || p_type || p_partkey AS schema, 'gone' AS missing FROM part
    UNION ALL SELECT p_partkey, 'components/schemas/' || p_type || p_partkey || '/properties/' || replace(p_name, ' ', '_'), 'lost' FROM part""")
def missing_required(w):
    documents = w.table("part").selectExpr("p_partkey", f"{SCHEMA_JSON} AS source")
    return schemas.missing_required(documents, "p_partkey", "source")


@query("markup_facts", """
    SELECT page_id, CASE WHEN name = 'a' THEN 'link' ELSE 'tag' END AS kind, name, line, col,
      'repo://pages/' || page_id || '#L' || line || ':C' || col AS evidence_uri FROM (
      SELECT page_id, line, i, lower(regexp_extract(piece, '^([A-Za-z][A-Za-z0-9]*)', 1)) AS name,
        (coalesce(sum(length(piece) + 1) OVER (PARTITION BY page_id, line ORDER BY i
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS col
      FROM (SELECT page_id, line, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM (
        SELECT page_id, string_split(ls[k], '<') AS ps, k::INT AS line FROM (
          SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (
            SELECT page_id, string_split(html, chr(10)) AS ls FROM pages)))))
    WHERE i > 0 AND name <> ''""")
def markup_facts(w):
    return schemas.markup_facts(w.table("pages"), "page_id", "html", "pages")


@query("evidence_uri", """
    SELECT page_id, line, 'repo://pages/' || page_id || '#L' || line || ':C' || strpos(text, 'href') AS evidence_uri FROM (
      SELECT page_id, unnest(range(1, len(ls) + 1))::INT AS line, unnest(ls) AS text FROM (
        SELECT page_id, string_split(html, chr(10)) AS ls FROM pages)) WHERE contains(text, 'href')""")
def evidence_uri(w):
    lines = w.table("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "text"))
    return lines.where(F.contains("text", F.lit("href"))).select(
        "page_id", (F.col("pos") + 1).alias("line"),
        F.concat(F.lit("repo://pages/"), "page_id", F.lit("#L"), F.col("pos") + 1, F.lit(":C"), F.instr("text", "href"))
        .alias("evidence_uri"))


add_view("artifact_checks", "", """
    SELECT doc_id AS check_id, text, ['sql_transaction', 'schema_version', 'no_literal_credentials',
      'sql_transaction', 'proto_openapi'][doc_id % 5 + 1] AS validator,
      ['.sql', '.avsc', '.env', '.txt', '.json'][doc_id % 5 + 1] AS sfx FROM documents""")


@query("validator_dispatch", """
    SELECT check_id, effect <> 'artifact is compatible' AS violated, effect,
      CASE WHEN sfx = '.txt' THEN 'validator ' || validator || ' does not support artifact: conf/' || check_id || sfx
        WHEN check_id % 15 = 4 THEN 'contract document cannot be read: conf/' || check_id || sfx END AS fault
    FROM (SELECT *, CASE WHEN sfx = '.sql' AND check_id % 10 = 5 THEN 'migration write is not transactional'
      WHEN sfx = '.avsc' AND NOT contains(lower(text), 'version') THEN 'message schema has no version'
      WHEN sfx = '.env' AND regexp_matches(text, '(?i)(password|secret|token|api[_-]?key)\\s*=\\s*[^${\\s][^\\s]*')
        THEN 'configuration contains a literal credential'
      WHEN check_id % 15 = 14 THEN 'published OpenAPI field removed' ELSE 'artifact is compatible' END AS effect FROM artifact_checks)""",
       "artifact_checks")
def validator_dispatch(w):
    # SQL artifacts wrap the text into a literal next to a write, half of them in a transaction.
    checks = w.table("documents").selectExpr(
        "doc_id AS check_id", "element_at(array('sql_transaction', 'schema_version', 'no_literal_credentials', "
        "'sql_transaction', 'proto_openapi'), cast(doc_id % 5 AS INT) + 1) AS validator",
        "concat('conf/', doc_id, element_at(array('.sql', '.avsc', '.env', '.txt', '.json'), cast(doc_id % 5 AS INT) + 1)) AS path",
        """CASE WHEN doc_id % 5 IN (0, 3) THEN concat(IF(doc_id % 10 = 0, 'BEGIN; ', ''), 'INSERT INTO t VALUES (''',
            replace(text, '''', ''''''), '''); COMMIT')
            WHEN doc_id % 15 = 4 THEN 'openapi: 3.0.0' WHEN doc_id % 15 = 9 THEN '{"openapi": "3", "a": [{"required": ["x"], "properties": {"x": {}}}]}'
            WHEN doc_id % 15 = 14 THEN '{"openapi": "3", "a": [{"required": ["y"], "properties": {"x": {}}}]}' ELSE text END AS source""",
        "cast(NULL AS STRING) AS baseline")
    return jobs.validate(checks)


@query("legacy_card", """
    SELECT change_id, fault, CASE WHEN fault IS NOT NULL THEN 'CHECK_INCOMPLETE' WHEN change_id % 4 = 1 THEN 'BLOCK' ELSE 'ALLOW' END AS decision
    FROM (SELECT change_id, CASE WHEN fault IN (3, 12, 13, 23, 33, 43) THEN 'diff_parse'
      WHEN ext NOT IN ('sql', 'proto', 'java') THEN 'policy_uncovered' WHEN change_id % 11 = 5 THEN 'diff_parse' END AS fault FROM shaped)""",
       "shaped")
def legacy_card(w):
    lines = cut_lineage(diffs.diff_lines(w.diffs))
    contracts = w.table("documents").selectExpr(
        "doc_id", "source", "element_at(array('sql', 'proto', 'yaml', 'avsc', 'properties', 'java'), cast(doc_id % 6 AS INT) + 1) AS ext"
    ).selectExpr("concat('docs/', source, '/', doc_id, '.', ext) AS path",
                 "IF(ext IN ('sql', 'proto', 'java'), array('p1'), array()) AS policy_ids")
    findings = w.table("documents").selectExpr(
        "doc_id AS change_id", "CASE WHEN doc_id % 11 = 5 THEN 'incomplete' WHEN doc_id % 4 = 1 THEN 'violated' "
        "ELSE 'passed' END AS outcome")
    return jobs.legacy_cards(w.diffs, lines, contracts, w.gdocs, findings)


def context_tasks(w):
    """One task for each request, about the repository of one brand."""
    brands = w.table("part").select("p_brand").distinct().selectExpr(
        "cast(substr(p_brand, 7) AS BIGINT) AS n", "lower(replace(p_brand, '#', '-')) AS repo")
    return w.requests.withColumn("n", F.expr("request_id % 25 + 1")).join(brands, "n").withColumns({
        "repos": F.array("repo"), "hints": F.array().cast("array<string>")})


@query("context_packs")
def context_packs(w):
    packs = jobs.context_packs(context_tasks(w), w.nodes, w.edges, w.gdocs, w.policies, now(), 2000, TOP_K)
    return packs.select("pack_id", "layer", "rank", "tokens", "upto", "kept", "fault")


PACK_BUDGET = 15  # one mandatory policy fits, two do not
LEXICAL = "'[\\p{L}\\p{N}_-]+'"


@query("context_pack_facts", f"""
    WITH tasks AS (SELECT r.*, lower(replace(b.p_brand, '#', '-')) AS repo FROM requests r
        JOIN (SELECT DISTINCT p_brand FROM part) b ON substr(p_brand, 7)::BIGINT = request_id % 25 + 1),
      s AS (SELECT request_id, id, label, len(list_filter(terms, lambda t: contains(txt, t))) AS hits, len(terms) AS n,
          CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_intersect(terms, b)) / sqrt(len(terms)::DOUBLE * len(b)) END AS sem FROM (
        SELECT t.request_id, n.id, n.label, lower(n.id || ' ' || n.label) AS txt, list_distinct(regexp_extract_all(lower(t.query), {LEXICAL})) AS terms,
          list_distinct(regexp_extract_all(lower(n.id || ' ' || n.label), {LEXICAL})) AS b
        FROM tasks t JOIN nodes n ON contains(n.id, t.repo))),
      best AS (SELECT request_id, id, least(0.95::DOUBLE, hits / greatest(1, n) + 0.35::DOUBLE * sem) AS conf FROM s
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY hits + sem DESC, CASE WHEN contains(label, '.') THEN 4 ELSE 3 END DESC, id) = 1),
      picked AS (SELECT t.request_id, t.revision, conf, CASE WHEN conf = 0 THEN 'unknown://task/' || substr(sha256(t.query), 1, 16) ELSE id END AS symbol
        FROM tasks t JOIN best USING (request_id)),
      must AS (SELECT DISTINCT request_id, policy_id FROM (SELECT request_id, unnest(policy_ids) AS policy_id FROM pairs) JOIN policies USING (policy_id)
        WHERE severity = 'critical'),
      kept AS (SELECT request_id, count(*) AS n_policies FROM must GROUP BY 1)
    SELECT request_id AS pack_id, symbol, round(conf, 6) AS confidence, round(CASE WHEN n_policies > 1 THEN 1 / n_policies ELSE 1 END, 6)::DOUBLE AS mandatory_policy_recall,
      revision <> 'r1' AS stale, concat_ws(',', CASE WHEN conf = 0 THEN 'NO_MATCHING_SYMBOL' END, CASE WHEN revision <> 'r1' THEN 'NO_INDEXED_ROUTE'
        WHEN conf = 0 OR NOT contains(symbol, '/part/') THEN 'NO_INDEXED_ROUTE'
        WHEN p_size >= 49 AND p_type = 'ECONOMY' THEN 'DYNAMIC_BOUNDARY' WHEN p_size >= 49 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem) THEN 'NO_INDEXED_ROUTE' END) AS unknowns,
      CASE WHEN n_policies > 1 THEN 'mandatory context exceeds token_budget' END AS fault
    FROM picked LEFT JOIN kept USING (request_id) LEFT JOIN part_ids ON node = symbol""", "requests nodes part_ids pairs policies")
def context_pack_facts(w):
    """What a pack tells about itself, under a budget that holds one mandatory policy; revision r1 is indexed."""
    facts = jobs.context_pack_facts(context_tasks(w), w.nodes, w.edges, w.gdocs, w.policies, now(), PACK_BUDGET, TOP_K, REVISION)
    return facts.select("pack_id", "symbol", F.round("confidence", 6).alias("confidence"),
                        F.round("mandatory_policy_recall", 6).alias("mandatory_policy_recall"), "stale",
                        F.array_join("unknowns", ",").alias("unknowns"), "fault")


add_view("gated", "bundles report", ENTRIES["calibration_gates"].body)


@query("promotion_gate", """
    SELECT policy_id, reason, detail FROM (SELECT policy_id, g.reasons AS detail,
        CASE WHEN step > 1 THEN 'policy promotion must advance one stage'
          WHEN step = 1 AND NOT (g.eligible AND from_mode = mode) THEN 'policy calibration gate failed' END AS reason
      FROM (SELECT *, list_position(['draft', 'shadow', 'warning', 'blocking'], target_mode)
          - list_position(['draft', 'shadow', 'warning', 'blocking'], mode) AS step FROM bundles)
      JOIN gated g USING (policy_id)) WHERE reason IS NOT NULL""", "bundles gated")
def promotion_gate(w):
    """Registry changes checked against the calibration evidence of each policy."""
    report = gate_report(w, "src17", "src18").select("policy_id", "eligible", "from_mode", "target_mode", "mode", "owner", "precision", "reasons")
    fixed = {"validator": F.lit("v"), "scope": F.lit("s"), "severity": F.lit("high"),
             "required_tests": F.array(F.lit("t")), "file_patterns": F.array(F.lit("*.sql"))}
    base = report.select("policy_id", "mode", "owner", "precision").withColumns(fixed)
    current = report.select("policy_id", F.col("target_mode").alias("mode"), "owner", "precision").withColumns(fixed)
    unsafe = calibration.registry_diff(base, current, report.select("policy_id", "eligible", "from_mode", "target_mode"))
    return unsafe.join(report.select("policy_id", F.array_join("reasons", "; ").alias("detail")), "policy_id")


add_view("naive", "diffs", ENTRIES["naive_baseline"].body)
add_view("ablation", "predictions diffs changes decided requests hybrid naive", """
    SELECT task_id, truth, impact, 'full' AS predictor, CASE d.decision WHEN 'ALLOW' THEN 'allow' WHEN 'ALLOW_WITH_TESTS' THEN 'tests'
      WHEN 'REQUIRE_APPROVAL' THEN 'approval' ELSE 'block' END AS prediction FROM predictions p JOIN decided d ON d.change_id = task_id
    UNION ALL SELECT task_id, truth, impact, 'recorded', prediction FROM predictions
    UNION ALL SELECT task_id, truth, impact, 'rules', CASE WHEN tests_passed IS NOT TRUE THEN 'tests'
      WHEN NOT version_known THEN 'approval' ELSE 'allow' END FROM predictions JOIN changes ON change_id = task_id
    UNION ALL SELECT task_id, truth, impact, 'retrieval', CASE WHEN b IS NULL THEN 'approval' WHEN b THEN 'block' WHEN m THEN 'tests' ELSE 'allow' END
      FROM predictions LEFT JOIN (SELECT request_id, bool_or(list_contains(policy_ids, 'p1')) AS b,
        bool_or(contains(lower(content), 'token')) AS m FROM hybrid GROUP BY 1) ON request_id = task_id % (SELECT count(*) FROM benchmark)
    UNION ALL SELECT task_id, truth, impact, 'naive', coalesce(n.prediction, 'allow')
      FROM predictions p LEFT JOIN naive n ON n.change_id = task_id % (SELECT count(*) FROM documents)""")


@query("ablation_report", """
    WITH sc AS (SELECT predictor, state, tp / greatest(called, 1) AS precision, tp / greatest(actual, 1) AS recall,
        CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0 * tp / (called + actual) END AS f1 FROM (
        SELECT predictor, s.state, (count(*) FILTER (truth = s.state AND prediction = s.state))::DOUBLE AS tp,
          count(*) FILTER (prediction = s.state) AS called, count(*) FILTER (truth = s.state) AS actual
        FROM ablation, (VALUES ('allow'), ('tests'), ('approval'), ('block')) s(state) GROUP BY 1, 2))
    SELECT predictor, round(max(macro), 6) AS macro_f1, round(max(br), 6) AS critical_violation_recall,
      round(max(ap), 6) AS approval_precision, round(max(ar), 6) AS approval_recall, round(max(tr), 6) AS required_test_recall,
      round(coalesce(count(*) FILTER (truth = 'block' AND prediction = 'allow') / nullif(count(*) FILTER (truth = 'block'), 0), 0), 6) AS unsafe_allow_rate,
      round(count(*) FILTER (truth <> 'block' AND prediction = 'block') / count(*) FILTER (truth <> 'block'), 6) AS false_block_rate,
      round(count(*) FILTER (impact AND prediction <> 'allow') / count(*) FILTER (impact), 6) AS impact_recall
    FROM ablation JOIN (SELECT predictor, sum(f1) / 4 AS macro, max(recall) FILTER (state = 'block') AS br,
        max(precision) FILTER (state = 'approval') AS ap, max(recall) FILTER (state = 'approval') AS ar,
        max(recall) FILTER (state = 'tests') AS tr FROM sc GROUP BY 1) USING (predictor)
    GROUP BY 1""", "ablation")
def ablation_report(w):
    from tidegate.catalog.decisions import decided

    truth = w.predictions.select("task_id", "truth", "impact")
    outcome = {"ALLOW": "allow", "ALLOW_WITH_TESTS": "tests", "REQUIRE_APPROVAL": "approval", "BLOCK": "block"}
    full = decided(w).select(F.col("change_id").alias("task_id"), F.lit("full").alias("predictor"),
                             decisions.lookup("decision", outcome).alias("prediction"))
    recorded = w.predictions.select("task_id", F.lit("recorded").alias("predictor"), "prediction")
    rules = w.changes.selectExpr(
        "change_id AS task_id", "'rules' AS predictor", "CASE WHEN tests_passed IS NOT TRUE THEN 'tests' "
        "WHEN NOT version_known THEN 'approval' ELSE 'allow' END AS prediction")
    found = retrieval.hybrid_search(w.requests, w.gdocs, now(), TOP_K).select("request_id", "id").join(
        w.gdocs.select("id", "policy_ids", "content"), "id")
    answers = retrieval.rag_baseline(w.requests, found, "p1", "token")
    lookup = truth.select("task_id", w.item_of("task_id").alias("request_id")).join(answers, "request_id", "left").select(
        "task_id", F.lit("retrieval").alias("predictor"), F.coalesce("prediction", F.lit("approval")).alias("prediction"))
    # the heuristic sees the diff alone; documents are numbered from 0
    documents = w.table("documents").agg(F.count(F.lit(1))).first()[0]
    heuristic = ENTRIES["naive_baseline"].build(w).withColumnRenamed("change_id", "doc")
    naive = truth.select("task_id", F.pmod("task_id", F.lit(max(1, documents))).alias("doc")).join(heuristic, "doc", "left").select(
        "task_id", F.lit("naive").alias("predictor"), F.coalesce("prediction", F.lit("allow")).alias("prediction"))
    rows = full.unionByName(recorded).unionByName(rules).unionByName(lookup).unionByName(naive)
    result = jobs.ablation_report(truth.join(rows, "task_id"))
    return rounded(result, *[c for c in result.columns if c != "predictor"])
