"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query
from tidegate.catalog.scalars import UNIT_SQL
from tidegate.functions import text
from tidegate.operators import artifacts, calibration, context, ordered

RUN = 4096


@query("rank_with_tiebreak", """
    SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, position FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey,
        l_partkey, l_linenumber) AS position FROM lineitem) WHERE position <= 5""")
def rank_with_tiebreak(w):
    rows = w.table("lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_linenumber")]
    return ordered.top_k(rows, ["l_suppkey"], order, 5)


@query("latest_per_key", """
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(w):
    return ordered.latest(w.table("events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("audit_replay", """
    SELECT user_id, event_id, event_type AS action,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events""")
def audit_replay(w):
    rows = w.table("events").select("user_id", "event_id", F.col("event_type").alias("action")).withColumn(
        "bucket", F.expr(f"event_id div {RUN}"))
    return ordered.ranked(rows, ["user_id"], "bucket", [F.col("event_id")]).drop("bucket")


LAYER = ("element_at(array('mandatory', 'structural', 'evidence', 'rationale', 'rationale', 'expandable'), "
         "least(turn, 5) + 1)")


def pack_items(w):
    return w.table("conversations").select(
        F.col("conv_id").alias("pack_id"), F.expr(LAYER.replace("turn", "cast(turn AS INT)")).alias("layer"),
        F.col("turn").alias("rank"),
        text.token_estimate(text.json_string(F.col("text"))).cast("long").alias("tokens"))


BUDGET_SQL = f"""
    SELECT pack_id, layer, rank, tokens, upto, upto <= 500 AS kept,
      CASE WHEN layer = 'mandatory' AND upto > 500 THEN 'mandatory context exceeds token_budget' END AS fault
    FROM (SELECT *, sum(tokens) OVER (PARTITION BY pack_id ORDER BY rank)::BIGINT AS upto FROM (
      SELECT conv_id AS pack_id, turn AS rank,
        ['mandatory', 'structural', 'evidence', 'rationale', 'rationale', 'expandable'][least(turn, 5) + 1] AS layer,
        len(regexp_extract_all(to_json(text)::VARCHAR, '{UNIT_SQL}')) AS tokens FROM conversations))"""


@query("token_budget", BUDGET_SQL)
def token_budget(w):
    return context.token_budget(pack_items(w), F.lit(500))


@query("truncated_layers", f"""SELECT pack_id, layer, count(*) AS n_items, count(*) FILTER (kept) AS n_kept,
    bool_or(NOT kept) AS truncated FROM ({BUDGET_SQL}) GROUP BY ALL""")
def truncated_layers(w):
    return context.truncated_layers(context.token_budget(pack_items(w), F.lit(500)))


@query("sql_transaction_state", """
    SELECT event_id, user_id FROM (
      SELECT *, last_value(CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'end'
          WHEN 'error' THEN 'end' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker FROM events)
    WHERE event_type = 'click' AND marker IS DISTINCT FROM 'begin'""")
def sql_transaction_state(w):
    statements = w.table("events").selectExpr(
        "user_id", "event_id", f"event_id div {RUN} AS bucket",
        "CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' "
        "WHEN 'click' THEN 'update' ELSE 'select' END AS verb")
    return artifacts.untransactional_writes(
        statements, ["user_id"], "bucket", [F.col("event_id")], F.array("verb")).select("event_id", "user_id")


@query("mode_transition", """
    SELECT policy_id, rev, mode, previous, CASE WHEN previous IS NULL THEN 'new'
      WHEN rk = prk + 1 THEN 'promoted' WHEN rk > prk THEN 'multi_stage' WHEN rk < prk THEN 'rolled_back'
      ELSE 'same' END AS step
    FROM (SELECT *, lag(mode) OVER (PARTITION BY policy_id ORDER BY rev) AS previous,
        lag(rk) OVER (PARTITION BY policy_id ORDER BY rev) AS prk FROM (
      SELECT o_custkey AS policy_id, o_orderkey AS rev,
        ['draft', 'shadow', 'warning', 'blocking'][(o_orderkey * 3 + o_custkey) % 4 + 1] AS mode,
        (o_orderkey * 3 + o_custkey) % 4 + 1 AS rk FROM orders))""")
def mode_transition(w):
    rows = w.table("orders").selectExpr(
        "o_custkey AS policy_id", "o_orderkey AS rev", f"o_orderkey div {RUN} AS bucket",
        "element_at(array('draft', 'shadow', 'warning', 'blocking'), "
        "cast((o_orderkey * 3 + o_custkey) % 4 AS INT) + 1) AS mode")
    seen = ordered.last_before(rows, ["policy_id"], "bucket", [F.col("rev")], F.col("mode"), "previous")
    step = calibration.mode_rank(F.col("mode")) - calibration.mode_rank(F.col("previous"))
    return seen.select("policy_id", "rev", "mode", "previous", F.when(step.isNull(), "new").when(
        step == 1, "promoted").when(step > 1, "multi_stage").when(step < 0, "rolled_back").otherwise("same")
        .alias("step"))


@query("forward_fill_scope", """
    SELECT doc_id, line_no, package, message, field, strpos(line, field || ' =') AS col FROM (
      SELECT doc_id, line_no, line, unnest(fields) AS field,
        coalesce(last_value(CASE WHEN line_no % 7 = 0 THEN 'pkg' || line_no END IGNORE NULLS) OVER w, 'default') AS package,
        coalesce(last_value(CASE WHEN line_no % 3 = 1 AND line_no % 7 <> 0 THEN 'M' || line_no END IGNORE NULLS) OVER w, '') AS message
      FROM (SELECT doc_id, line_no, line, list_distinct(['f' || line_no, 'g' || length(src)]) AS fields FROM (
        SELECT doc_id, i - 1 AS line_no, src, CASE WHEN (i - 1) % 7 = 0 THEN 'package pkg' || (i - 1)
            WHEN (i - 1) % 3 = 1 THEN 'message M' || (i - 1) || ' {' ELSE '' END
            || ' string f' || (i - 1) || ' = 1; bool g' || length(src) || ' = 2; ' || src AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, generate_subscripts(string_split(text, chr(10)), 1) AS i,
            string_split(text, chr(10))[generate_subscripts(string_split(text, chr(10)), 1)] AS src FROM documents)))
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))""")
def forward_fill_scope(w):
    body = """array_join(transform(split(text, '\\n'), (src, i) -> concat(
        CASE WHEN i % 7 = 0 THEN concat('package pkg', i) WHEN i % 3 = 1 THEN concat('message M', i, ' {') ELSE '' END,
        ' string f', i, ' = 1; bool g', length(src), ' = 2; ', src)), '\\n')"""
    files = w.table("documents").selectExpr("doc_id", f"{body} AS source")
    return artifacts.scoped_fields(files, "doc_id", "source")


SCRIPT = ("concat('-- note; drop\\n', CASE event_type WHEN 'click' THEN "
          "concat('UPDATE ledger SET v = ''a;b'' WHERE k IN (SELECT k; FROM (DELETE)) /* x; y */; SELECT ', user_id) "
          "WHEN 'view' THEN 'BEGIN; INSERT INTO t VALUES (1); COMMIT; DELETE FROM t' "
          "WHEN 'signup' THEN 'start transaction; WITH a AS (UPDATE x) MERGE INTO t' "
          "ELSE 'SELECT \"a;b\" FROM t); SELECT f(g(1), 2) FROM c' END)")


@query("sql_statements", """
    SELECT event_id, unnest(n)::BIGINT AS statement_no, unnest(s) AS tokens FROM (SELECT event_id,
      CASE event_type WHEN 'click' THEN [0, 1] WHEN 'view' THEN [0, 1, 2, 3] WHEN 'signup' THEN [0, 1] ELSE [0, 1] END AS n,
      CASE event_type WHEN 'click' THEN ['update ledger set v where k in', 'select ' || user_id]
        WHEN 'view' THEN ['begin', 'insert into t values', 'commit', 'delete from t']
        WHEN 'signup' THEN ['start transaction', 'with a as merge into t']
        ELSE ['select from t', 'select f from c'] END AS s FROM events)""")
def sql_statements(w):
    scripts = w.table("events").selectExpr("event_id", f"{SCRIPT} AS source")
    return artifacts.sql_statements(scripts, "event_id", "source").select(
        "event_id", "statement_no", F.array_join("tokens", " ").alias("tokens"))


@query("sql_scripts_unsafe", """SELECT event_id FROM events WHERE event_type IN ('click', 'view')""")
def sql_scripts_unsafe(w):
    scripts = w.table("events").selectExpr("event_id", f"{SCRIPT} AS source")
    return artifacts.unsafe_scripts(scripts, "event_id", "source")


PROTO = """concat('syntax = "proto3"; // message X { int32 a = 1; }\\n',
    'message ', p_type, p_partkey, ' { int64 id = 1; repeated string ', replace(p_name, ' ', '_'), ' = ', p_size + 2,
    ' [deprecated = true]; message Inner { bool flag = 7; enum Kind { NONE = 0; } oneof pick { double price = 3; ',
    'Other other = ', p_partkey % 90 + 10, '; } reserved 5; } option (x) = { a: 1 }; map<string, int32> tags = 99 }')"""


@query("proto_fields", """
    SELECT p_partkey, message, field, number FROM (SELECT p_partkey,
      unnest([m, m, m, m || '.Inner', m || '.Inner', m || '.Inner']) AS message,
      unnest(['id', replace(p_name, ' ', '_'), 'tags', 'flag', 'price', 'other']) AS field,
      unnest([1, p_size + 2, 99, 7, 3, p_partkey % 90 + 10])::BIGINT AS number
    FROM (SELECT *, p_type || p_partkey AS m FROM part))""")
def proto_fields(w):
    files = w.table("part").selectExpr("p_partkey", f"{PROTO} AS source")
    return artifacts.proto_fields(files, "p_partkey", "source")
