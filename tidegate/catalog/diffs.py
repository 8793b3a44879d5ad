"""Diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate import session
from tidegate.catalog.base import query
from tidegate.catalog.joins import registry_globs
from tidegate.catalog.oracle_views import add_view
from tidegate.operators import diffs, filters

add_view("dl", "diffs", """
    SELECT *, CASE WHEN hunk_no > 0 AND NOT starts_with(line, '@@ ') THEN line[1] END AS marker FROM (
      SELECT change_id, pos, line, file_no,
        CASE WHEN file_no > 0 AND part = 'hunk' THEN hunk_seq ELSE 0 END AS hunk_no FROM (
        SELECT change_id, pos, line, count_if(starts_with(line, 'diff --git ')) OVER w AS file_no,
          count_if(starts_with(line, '@@ ')) OVER w AS hunk_seq,
          last_value(CASE WHEN starts_with(line, 'diff --git ') THEN 'header'
            WHEN starts_with(line, '@@ ') THEN 'hunk' END IGNORE NULLS) OVER w AS part
        FROM (SELECT change_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
          FROM (SELECT change_id, string_split(diff_text, chr(10)) AS ls FROM diffs))
        WINDOW w AS (PARTITION BY change_id ORDER BY pos ROWS UNBOUNDED PRECEDING)))""")


def lines(w):
    return diffs.diff_lines(w.diffs)


@query("diff_segments", """
    SELECT change_id, pos, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, marker,
      CASE WHEN marker IN (' ', '-') THEN s + count_if(marker IN (' ', '-')) OVER w - 1 END::BIGINT AS old_no,
      CASE WHEN marker IN (' ', '+') THEN t + count_if(marker IN (' ', '+')) OVER w - 1 END::BIGINT AS new_no
    FROM (SELECT *, regexp_extract(h, '^@@ -(\\d+),\\d+ \\+(\\d+),', 1)::INT AS s,
        regexp_extract(h, '^@@ -(\\d+),\\d+ \\+(\\d+),', 2)::INT AS t
      FROM dl LEFT JOIN (SELECT change_id, hunk_no, line AS h FROM dl WHERE hunk_no > 0 AND starts_with(line, '@@ '))
        USING (change_id, hunk_no))
    WINDOW w AS (PARTITION BY change_id, file_no, hunk_no ORDER BY pos ROWS UNBOUNDED PRECEDING)""", "dl")
def diff_segments(w):
    return lines(w).select("change_id", F.col("pos").cast("long").alias("pos"), "file_no", "hunk_no",
                           "marker", "old_no", "new_no")


add_view("shaped", "diff_parts", """
    SELECT *, doc_id AS change_id, CASE shape WHEN 0 THEN NULL ELSE old_p END AS old_path,
      CASE WHEN shape = 1 OR fault = 43 THEN NULL WHEN fault = 3 THEN '../' || new_p ELSE new_p END AS new_path,
      CASE WHEN shape = 0 THEN 'add' WHEN shape = 1 OR fault = 43 THEN 'delete' WHEN shape = 2 THEN 'rename'
        ELSE 'modify' END AS operation,
      CASE shape WHEN 1 THEN 0 WHEN 0 THEN n ELSE 1 END AS n_added,
      CASE shape WHEN 0 THEN 0 WHEN 1 THEN n ELSE 1 END AS n_removed FROM diff_parts""")


@query("diff_files", """
    SELECT change_id, 1::BIGINT AS file_no, CASE WHEN fault = 12 THEN NULL ELSE old_path END AS old_path,
      new_path, operation, n_added::BIGINT AS n_added, n_removed::BIGINT AS n_removed
    FROM shaped WHERE fault <> 23""", "shaped")
def diff_files(w):
    return diffs.diff_files(lines(w)).select(
        "change_id", "file_no", "old_path", "new_path", "operation", "n_added", "n_removed")


@query("diff_faults", """
    SELECT change_id, CASE fault WHEN 3 THEN 'unsafe path'
      WHEN 12 THEN 'renames must provide both rename from and rename to' WHEN 13 THEN 'truncated hunk'
      WHEN 23 THEN 'input contains no diff --git file header' WHEN 33 THEN 'binary diffs are not supported'
      ELSE 'each changed file needs ---, +++, and at least one @@ hunk' END AS fault
    FROM shaped WHERE fault IN (3, 12, 13, 23, 33, 43)""", "shaped")
def diff_faults(w):
    return diffs.diff_faults(w.diffs, session.cut_lineage(lines(w)))


def parsed_files(w):
    """Files of the changes that parse, with hunks and the stored file."""
    # Read by nine later steps.
    table = session.cut_lineage(lines(w))
    faulty = diffs.diff_faults(w.diffs, table).select("change_id").distinct()
    files = diffs.diff_files(table).join(faulty, "change_id", "left_anti")
    stored = w.diffs.select("change_id", F.lit(1).cast("long").alias("file_no"), "stored_text")
    return files, diffs.file_hunks(table), stored


add_view("sound", "shaped", "SELECT *, doc_id % 7 AS st FROM shaped WHERE fault NOT IN (3, 12, 13, 23, 33, 43)")


@query("apply_hunks", """
    SELECT change_id, n_lines, CASE WHEN n_lines > 0 THEN md5(array_to_string(out, chr(10))) END AS digest FROM (
      SELECT change_id, out, CASE WHEN out IS NOT NULL THEN len(out) END AS n_lines FROM (
        SELECT change_id, CASE WHEN shape = 0 THEN ls WHEN st IN (1, 3) THEN NULL
          ELSE list_concat(CASE WHEN st = 2 THEN ['# header', '# moved'] ELSE [] END,
            CASE WHEN shape = 1 THEN [] ELSE list_concat([ls[1] || ' (changed)'], ls[2:]) END) END AS out
        FROM sound))""", "sound")
def apply_hunks(w):
    files, hunks, stored = parsed_files(w)
    base = files.join(stored, ["change_id", "file_no"]).join(hunks, ["change_id", "file_no"]).withColumn(
        "base", F.when(F.col("operation") == "add", F.array().cast("array<string>"))
        .otherwise(F.split("stored_text", "\n")))
    out = base.withColumn("out", diffs.patched("base", "hunks"))
    return out.select("change_id", F.when(F.col("out").isNotNull(), F.size("out")).cast("long").alias("n_lines"),
                      F.when(F.size("out") > 0, F.md5(F.array_join("out", "\n"))).alias("digest"))


@query("locate_hunk", """
    SELECT change_id, CASE WHEN shape = 0 THEN NULL WHEN st IN (1, 3) THEN NULL WHEN st = 2 THEN 2 ELSE 0 END::BIGINT
      AS line_index FROM sound WHERE shape <> 0""", "sound")
def locate_hunk(w):
    files, hunks, stored = parsed_files(w)
    rows = files.where("operation <> 'add'").join(stored, ["change_id", "file_no"]).join(
        hunks, ["change_id", "file_no"]).withColumn("base", F.split("stored_text", "\n"))
    # The line where the first hunk lands is what a patch of that hunk alone keeps in front.
    marked = rows.withColumn("probe", F.expr(
        "transform(slice(hunks, 1, 1), h -> named_struct('hunk_no', h.hunk_no, 'old_start', h.old_start, "
        "'new_start', h.new_start, 'before', h.before, 'after', array(concat('probe ', change_id)), "
        "'no_newline', h.no_newline))")).withColumn("out", diffs.patched("base", "probe"))
    return marked.select("change_id", F.nullif(F.expr(
        "array_position(out, concat('probe ', change_id)) - 1"), F.lit(-1).cast("long")).alias("line_index"))


@query("before_after_choice", """
    SELECT change_id, side, md5(CASE WHEN side = 'added' THEN '' WHEN side = 'after' THEN text ELSE stored END)
        AS before_digest,
      md5(CASE side WHEN 'added' THEN text WHEN 'after' THEN stored ELSE
        CASE WHEN shape = 1 THEN '' ELSE (CASE WHEN st = 2 THEN '# header' || chr(10) || '# moved' || chr(10) ELSE '' END)
          || array_to_string(list_concat([ls[1] || ' (changed)'], ls[2:]), chr(10)) END END) AS after_digest
    FROM (SELECT *, CASE WHEN shape = 0 THEN 'added' WHEN shape = 1 THEN CASE WHEN st IN (0, 4, 5, 6) THEN 'before' END
        WHEN st = 1 THEN 'after' WHEN st = 3 THEN NULL ELSE 'before' END AS side,
        CASE st WHEN 1 THEN array_to_string(list_concat([ls[1] || ' (changed)'], ls[2:]), chr(10))
          WHEN 2 THEN '# header' || chr(10) || '# moved' || chr(10) || text ELSE text END AS stored FROM sound)
    WHERE side IS NOT NULL""", "sound")
def before_after_choice(w):
    rebuilt = diffs.reconstruct(*parsed_files(w)).where("side IS NOT NULL")
    # The generated texts end with a line break unless the diff says otherwise.
    return rebuilt.select("change_id", "side", F.md5("before_text").alias("before_digest"),
                          F.md5(F.when(F.col("side") == "added", F.regexp_replace("after_text", r"\n\z", ""))
                                .otherwise(F.col("after_text"))).alias("after_digest"))


@query("governed_sides", """
    WITH p AS (SELECT change_id, old_path, new_path, CASE WHEN old_path IS NULL OR shape = 2 THEN NULL ELSE pol END AS o,
        CASE WHEN new_path IS NULL THEN NULL ELSE pol END AS q
      FROM (SELECT *, CASE ext WHEN 'sql' THEN 'ledger' WHEN 'proto' THEN 'contract' WHEN 'yaml' THEN 'contract'
        WHEN 'avsc' THEN 'schema' END AS pol FROM sound))
    SELECT change_id, o AS policy_id, old_path AS path, 'removed' AS check FROM p WHERE o IS NOT NULL AND q IS NULL
    UNION ALL SELECT change_id, q, new_path, CASE WHEN o IS NULL THEN 'after' ELSE 'compare' END FROM p WHERE q IS NOT NULL""",
       "sound")
def governed_sides(w):
    files, _, _ = parsed_files(w)
    # the twin knows three of the four policies
    return diffs.governed_sides(files, registry_globs(w)).where("policy_id <> 'credentials'").select(
        "change_id", "policy_id", "path", "check")


@query("public_contract_flag", """
    SELECT change_id, ext IN ('proto', 'yaml') OR regexp_matches(lower(CASE shape WHEN 1 THEN '' WHEN 0 THEN text
      ELSE ls[1] END), 'openapi|message |dto|enum |record ') AS public_contract FROM sound""", "sound")
def public_contract_flag(w):
    files, _, _ = parsed_files(w)
    return diffs.public_contract(files).select("change_id", "public_contract")


NAIVE_TEXT = ("CASE {k} % 8 WHEN 1 THEN concat({t}, chr(10), '-  IdempotencyStore.check(key)') "
              "WHEN 2 THEN concat({t}, chr(10), '+ idempotencyStore.check; ledger.redeem()') "
              "WHEN 3 THEN concat({t}, chr(10), ' refund_service') ELSE {t} END")


@query("naive_baseline", """
    SELECT change_id, CASE WHEN removed LIKE '%idempotencystore.check%' OR removed LIKE '%@transaction%' THEN 'block'
      WHEN added LIKE '%idempotencystore.check%' AND added LIKE '%ledger.redeem%' THEN 'tests'
      WHEN t LIKE '%coupon_client%' OR t LIKE '%refund_service%' THEN 'approval' ELSE 'allow' END AS prediction
    FROM (SELECT change_id, t, lower(array_to_string(list_filter(string_split(t, chr(10)),
          lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), chr(10))) AS removed,
        lower(array_to_string(list_filter(string_split(t, chr(10)),
          lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), chr(10))) AS added
      FROM (SELECT change_id, """ + NAIVE_TEXT.format(k="change_id", t="diff_text") + " AS t FROM diffs))", "diffs")
def naive_baseline(w):
    rows = w.diffs.selectExpr("change_id", NAIVE_TEXT.format(k="change_id", t="diff_text") + " AS t")
    return rows.select("change_id", diffs.naive_baseline(F.col("t")).alias("prediction"))


@query("diff_signals")
def diff_signals(w):
    rows = w.diffs.selectExpr(
        "change_id", "concat(diff_text, IF(change_id % 9 = 4, '\\n+  string couponId = 3;', '')) AS t")
    return rows.select("change_id", F.array_join(F.array_sort(diffs.diff_signals(F.col("t"))), " ").alias("signals"))


SYMBOLS_SQL = """SELECT change_id, CASE WHEN ext = 'proto' THEN 'proto://' || source || '/' || word
      ELSE 'repo://' || old_p || '#' || word END AS id, length(word) % 3 = 0 AS dynamic
    FROM (SELECT doc_id AS change_id, ext, source, old_p, unnest(list_distinct(regexp_extract_all(
      CASE WHEN doc_id % 4 = 3 THEN ls[n] ELSE ls[1] END, '[A-Za-z][A-Za-z0-9_]*'))) AS word FROM diff_parts)"""


@query("changed_symbol", f"""
    WITH sym AS (SELECT id, bool_or(dynamic) AS dynamic FROM ({SYMBOLS_SQL}) GROUP BY 1),
      req AS (SELECT change_id, regexp_extract(diff_text, '(?m)^--- a/(.+)$', 1) AS path, list_distinct(regexp_extract_all(
          array_to_string(list_transform(list_filter(string_split(diff_text, chr(10)),
            lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: substr(x, 2)), chr(10)),
          '[A-Za-z][A-Za-z0-9_]*')) AS tokens FROM diffs),
      cand AS (SELECT change_id, tokens, s.id, s.dynamic FROM req JOIN sym s ON
          split_part(s.id, '#', 1) = 'repo://' || path WHERE path NOT LIKE '%.proto' AND s.id LIKE '%#%'
        UNION ALL SELECT change_id, tokens, s.id, s.dynamic FROM req JOIN sym s ON s.id LIKE 'proto://%'
          WHERE path LIKE '%.proto'),
      scored AS (SELECT change_id, id, dynamic, len(list_filter(tokens, lambda t: contains(id, t))) AS hits FROM cand),
      pick AS (SELECT change_id, arg_min(id, (-hits, length(id), id)) FILTER (hits > 0) AS best,
        arg_min(id, (length(id), id)) FILTER (dynamic) AS fallback FROM scored GROUP BY 1)
    SELECT change_id, coalesce(best, fallback) AS node_id, CASE WHEN path = '' THEN 'malformed diff'
      WHEN coalesce(best, fallback) IS NULL THEN 'diff has no indexed changed artifact' END AS fault
    FROM req LEFT JOIN pick USING (change_id)""", "diffs diff_parts")
def changed_symbol(w):
    return diffs.changed_symbols(w.diffs, symbols(w))


def symbols(w):
    docs = w.table("documents").selectExpr(
        "doc_id", "source", "split(text, '\\n') AS ls",
        "element_at(array('sql', 'proto', 'yaml', 'avsc', 'properties', 'java'), cast(doc_id % 6 AS INT) + 1) AS ext",
        "doc_id % 10 AS shape")
    words = docs.selectExpr(
        "doc_id", "source", "ext", "shape", "explode(array_distinct(regexp_extract_all("
        "IF(doc_id % 4 = 3, element_at(ls, -1), ls[0]), '[A-Za-z][A-Za-z0-9_]*', 0))) AS word")
    return words.selectExpr(
        "IF(ext = 'proto', concat('proto://', source, '/', word), concat('repo://docs/', source, '/', doc_id, "
        "IF(shape = 2, '.md', concat('.', ext)), '#', word)) AS id", "length(word) % 3 = 0 AS dynamic"
    ).groupBy("id").agg(F.bool_or("dynamic").alias("dynamic"))
