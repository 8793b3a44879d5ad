"""Set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.catalog.base import query
from tidegate.catalog.metrics import DIGEST_SQL, FILE_HASH_SQL, WORDS_SQL, base_files
from tidegate.operators import sets


def trace_calls(w):
    return w.table("events").selectExpr(
        "event_id AS id", "concat('service://u', user_id) AS source_id",
        "concat('service://', event_type) AS target_id", "value AS confidence", "'r1' AS revision")


@query("trace_union", """
    SELECT edge_id, source, count(*) AS n, round(sum(confidence), 4) AS confidence FROM (
      SELECT edge_id, source, confidence FROM edges
      UNION ALL SELECT 'OBSERVED_CALL:service://u' || user_id || '->service://' || event_type, 'Trace', value
      FROM events) GROUP BY ALL""", "edges")
def trace_union(w):
    rows = sets.trace_union(w.edges, sets.observed_edges(trace_calls(w), "events.json"))
    return rows.groupBy("edge_id", "source").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


# the two slices overlap and cover the table
PREP = "l_linenumber % 3 <> 0"
DISC = "(l_linenumber % 2 = 1 OR l_linenumber % 3 = 0)"
PREP_SQL = f"SELECT l_orderkey AS change_id, 't' || (l_partkey % 9) AS item FROM lineitem WHERE {PREP}"
DISC_SQL = f"SELECT l_orderkey AS change_id, 't' || (l_partkey % 9) AS item FROM lineitem WHERE {DISC}"


def slices(w):
    rows = w.table("lineitem").selectExpr(
        "l_orderkey AS change_id", "concat('t', l_partkey % 9) AS item", "l_linenumber")
    return (rows.where(PREP).drop("l_linenumber"), rows.where(DISC).drop("l_linenumber"))


@query("requirements_union", f"{PREP_SQL} UNION {DISC_SQL}")
def requirements_union(w):
    return sets.requirements_union(*slices(w))


@query("added_except", f"""
    SELECT *, 'added' AS change FROM ({DISC_SQL} EXCEPT {PREP_SQL})
    UNION ALL SELECT *, 'removed' FROM ({PREP_SQL} EXCEPT {DISC_SQL})""")
def added_except(w):
    return sets.added_and_removed(*slices(w))


@query("contract_fields_removed", """
    WITH before AS (SELECT p_brand AS schema, p_name || p_partkey AS field,
        CASE WHEN p_partkey % 2 = 0 THEN p_size END AS number FROM part),
      after AS (SELECT p_brand AS schema, p_name || p_partkey AS field,
        CASE WHEN p_partkey % 2 = 0 THEN p_size + (p_retailprice > 1000)::INT END AS number
        FROM part WHERE p_type <> 'ECONOMY')
    SELECT schema, field, CASE WHEN a.field IS NULL THEN 'field removed' ELSE 'field number changed' END AS reason
    FROM before b LEFT JOIN after a USING (schema, field)
    WHERE a.field IS NULL OR a.number IS DISTINCT FROM b.number""")
def contract_fields_removed(w):
    part = w.table("part")
    before = part.selectExpr("p_brand AS schema", "concat(p_name, p_partkey) AS field",
                             "IF(p_partkey % 2 = 0, p_size, NULL) AS number")
    after = part.where("p_type <> 'ECONOMY'").selectExpr(
        "p_brand AS schema", "concat(p_name, p_partkey) AS field",
        "IF(p_partkey % 2 = 0, p_size + IF(p_retailprice > 1000, 1, 0), NULL) AS number")
    return sets.contract_breaks(before, after)


@query("virtual_digest", f"""
    SELECT repo, n_files, {DIGEST_SQL} AS digest FROM (SELECT repo, count(*) AS n_files, {WORDS_SQL}
      FROM (SELECT repo, {FILE_HASH_SQL} AS h FROM (
        SELECT repo, path, CASE WHEN doc_id % 6 = 1 THEN concat('changed ', content) ELSE content END AS content
        FROM base_files WHERE doc_id % 6 <> 2
        UNION ALL SELECT repo, path || '.new', content FROM base_files WHERE doc_id % 6 = 3)) GROUP BY 1)""",
       "base_files")
def virtual_digest(w):
    base = base_files(w)
    overrides = base.where("doc_id % 6 IN (1, 2, 3)").selectExpr(
        "repo", "IF(doc_id % 6 = 3, concat(path, '.new'), path) AS path",
        "CASE doc_id % 6 WHEN 1 THEN concat('changed ', content) WHEN 3 THEN content END AS content")
    return sets.virtual_digests(base, overrides, ["repo"])
