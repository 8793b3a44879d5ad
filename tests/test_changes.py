"""Registry globs, changes of several files, and the evaluation from diff to follow-up."""

from __future__ import annotations

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from tidegate import session
from tidegate.operators import diffs, joins
from tidegate.plans import jobs
from tidegate.sources import readers

REGISTRY = readers.REGISTRY_SCHEMAS["policies"]


def policy(name, globs, **more):
    return {"id": name, "validator": "sql_transaction", "severity": "critical", "mode": "blocking", "precision": "high",
            "owner": f"{name}-team", "required_tests": [f"{name}-test"], "file_patterns": globs, **more}


def test_glob_join_matches_every_pair(spark):
    rng = random.Random(2)
    globs = ["*", "**/*.sql", "*.sql", "db/*", "db/[!x]*.sql", "a?c", "[ab]*", "x[", "lit.eral", "", "*[0-9]", "*].sql", "db/x.sql"]
    pieces = ["db/", "x", "a", "b", "c", ".sql", "/", "[", "]", "7", "lit.eral", "é", "\n"]
    paths = sorted({"".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(300)} | {"db\\x.sql"})
    registry = spark.createDataFrame([policy(f"p{i}", [g, "never/*/x"]) for i, g in enumerate(globs)], REGISTRY)
    found = joins.matching_policies(spark.createDataFrame([(p,) for p in paths], "path STRING"), joins.policy_globs(registry))
    got = {(r.path, r.policy_id) for r in found.collect()}
    assert got == {(p, f"p{i}") for p in paths for i, g in enumerate(globs) if fnmatch.fnmatchcase(p.replace("\\", "/"), g)}
    none = joins.matching_policies(spark.createDataFrame([("a",)], "path STRING"), joins.policy_globs(registry.limit(0)))
    assert none.count() == 0


@pytest.mark.parametrize(("pattern", "anchor"), [
    ("**/*.sql", ("end", ".sql")), ("db/*", ("start", "db/")), ("db/x.sql", ("end", "db/x.sql")), ("a[x]b", ("end", "b")),
    ("abc*d", ("start", "abc")), ("*", ("end", "")), ("x[", ("start", "x"))])
def test_anchors(pattern, anchor):
    assert joins.glob_anchor(pattern) == anchor


TWO = """diff --git a/db/a.sql b/db/a.sql
--- a/db/a.sql
+++ b/db/a.sql
@@ -1,2 +1,2 @@
-BEGIN; UPDATE t SET a = 1; COMMIT;
+UPDATE t SET a = 2;
 -- one
@@ -4,1 +4,2 @@
 -- three
+-- four
diff --git a/old.sql b/new.txt
rename from old.sql
rename to new.txt
diff --git a/gone.sql b/gone.sql
--- a/gone.sql
+++ b/gone.sql
@@ -1,1 +1,1 @@
-x
+y"""
BEFORE = "BEGIN; UPDATE t SET a = 1; COMMIT;\n-- one\n-- two\n-- three\n"
AFTER = "UPDATE t SET a = 2;\n-- one\n-- two\n-- three\n-- four\n"


@pytest.mark.parametrize(("held", "side"), [(BEFORE, "before"), (AFTER, "after")])
def test_each_file_is_rebuilt_from_its_own_path(spark, held, side):
    changes = spark.createDataFrame([(1, TWO)], "change_id BIGINT, diff_text STRING")
    lines = diffs.diff_lines(changes)
    files = diffs.diff_files(lines)
    stored = spark.createDataFrame(
        [(1, "db/a.sql", held), (1, "new.txt", "moved"), (2, "gone.sql", "x")], "change_id BIGINT, path STRING, stored_text STRING")
    rows = {r.file_no: r for r in diffs.reconstruct(files, diffs.file_hunks(lines), diffs.stored_files(files, stored)).collect()}
    assert (rows[1].side, rows[1].before_text, rows[1].after_text) == (side, BEFORE, AFTER)
    assert (rows[2].side, rows[2].before_text, rows[2].after_text) == ("both", "moved", "moved")
    assert rows[3].side is None and rows[3].fault == "repository file exists in neither diff state"


SAFE = "diff --git a/db/a.sql b/db/a.sql\n--- a/db/a.sql\n+++ b/db/a.sql\n@@ -1,1 +1,1 @@\n-BEGIN; UPDATE t SET a = 1; COMMIT;\n+BEGIN; UPDATE t SET a = 2; COMMIT;"
UNSAFE = SAFE.replace("+BEGIN; UPDATE t SET a = 2; COMMIT;", "+UPDATE t SET a = 2;")
#: change: (diff, whether its file is stored, context, records of approvals as (bound to it, signed by), prepared items)
CASES = {
    1: (SAFE, True, None, None, []),
    2: (SAFE.replace("db/", "src/"), True, None, None, []),  # no row of the registry
    3: (UNSAFE, True, None, None, []),
    4: (SAFE, False, "c4", (True, ["db-team"]), []),
    5: (SAFE, False, "c5", (False, ["db-team"]), []),
    6: (SAFE, False, "c6", (True, ["else"]), []),
    7: (SAFE, False, "c7", None, []),
    8: (SAFE, False, None, None, []),
    9: (SAFE, True, "c9", None, [("test", "gone")]),
    10: (SAFE, True, "c10", None, [("test", "db-test")]),
    11: ("hello", True, "c11", None, []),
    12: ("hello", True, None, None, []),
    13: (SAFE.replace("db/", "new/"), True, None, None, []),  # a row that only the second registry has
}


@pytest.fixture(scope="module")
def evaluated(spark):
    changes = spark.createDataFrame(
        [(i, diff, None, {"__index__": "r1"}, "p1", context, "repo", "kb") for i, (diff, _, context, _, _) in CASES.items()],
        "change_id BIGINT, diff_text STRING, tests_passed BOOLEAN, base_revisions MAP<STRING, STRING>, policy_revision STRING, "
        "context_id STRING, repository_digest STRING, knowledge_digest STRING")
    held = "BEGIN; UPDATE t SET a = 1; COMMIT;\n"
    stored = [(i, f"{folder}/a.sql", held) for i, case in CASES.items() if case[1] for folder in ("db", "src", "new")]
    prepared = [(case[2], *item) for case in CASES.values() for item in case[4]]
    registry = [policy("db", ["db/*"]), policy("added", ["new/*"], required_tests=[])]
    assessed = jobs.assess_changes(
        changes, spark.createDataFrame(stored, "change_id BIGINT, path STRING, stored_text STRING"),
        spark.createDataFrame(registry, REGISTRY), spark.createDataFrame([], "id STRING, dynamic BOOLEAN"),
        spark.createDataFrame([], "edge_id STRING, source_id STRING, target_id STRING, kind STRING"),
        spark.createDataFrame([(i, "db-test", "r1", True) for i in CASES], "change_id BIGINT, test_id STRING, revision STRING, passed BOOLEAN"),
        spark.createDataFrame([("db-test",)], "item STRING"),
        spark.createDataFrame(prepared, "context_id STRING, role STRING, item STRING"),
        spark.createDataFrame([], "context_id STRING, prepared_digest STRING, current_digest STRING"))
    marks = {r.change_id: r.fingerprint for r in assessed["bound"].collect()}
    records = [
        (case[2], "p1", marks[i] if case[3][0] else "other", case[3][1], case[3][1], 1, "approved", None)
        for i, case in CASES.items() if case[3]
    ]
    result = jobs.settle_changes(assessed, spark.createDataFrame(
        records, "context_id STRING, policy_revision STRING, fingerprint STRING, approvers ARRAY<STRING>, approvals ARRAY<STRING>, "
        "required_cosigns INT, state STRING, waiver_expires_at TIMESTAMP"), F.lit("2024-02-01").cast("timestamp"))
    findings: dict = {i: {} for i in CASES}
    for r in result["findings"].collect():
        findings[r.change_id][r.finding_id] = r
    return (
        {r.change_id: r for r in result["decisions"].collect()}, findings,
        {r.change_id: (r.tool, r.reason) for r in result["actions"].collect()},
    )


def test_policies_come_from_the_registry_alone(evaluated):
    decisions, findings, actions = evaluated
    assert decisions[1].decision == "ALLOW" and not findings[1]["db:compare"].violated
    assert decisions[2].decision == "ALLOW" and not findings[2]
    assert decisions[3].decision == "BLOCK" and findings[3]["db:compare"].violated
    assert actions[3] == ("none", "resolve blocking findings before retrying") and 1 not in actions
    assert decisions[13].decision == "ALLOW" and set(findings[13]) == {"added:compare"}


def test_an_approval_releases_only_its_own_fingerprint(evaluated):
    decisions, findings, actions = evaluated
    assert "db:RECONSTRUCTION_INCOMPLETE" in findings[4]
    assert (decisions[4].decision, decisions[4].approval_state) == ("ALLOW", "approved")
    assert (decisions[5].decision, decisions[5].approval_state) == ("REQUIRE_APPROVAL", "fingerprint_mismatch")
    assert (decisions[6].decision, decisions[6].approval_state) == ("REQUIRE_APPROVAL", "approver_mismatch")
    assert decisions[7].decision == "REQUIRE_APPROVAL" and actions[7][0] == "request_approval"
    assert actions[8][0] == "prepare_change"


def test_a_prepared_context_may_drift_or_grow(evaluated):
    decisions, findings, _ = evaluated
    assert findings[9]["context:CONTEXT_DRIFT"].critical_unknown and decisions[9].decision == "REQUIRE_APPROVAL"
    assert "context:CONTEXT_EXPANDED" in findings[10]  # the owner was not prepared for
    assert decisions[10].decision == "ALLOW"


def test_unreadable_diff_asks_for_approval(evaluated):
    decisions, findings, actions = evaluated
    for i in (11, 12):
        assert (decisions[i].decision, decisions[i].risk_score) == ("REQUIRE_APPROVAL", 0.0) and "fault:diff_parse" in findings[i]
    assert actions[11] == ("none", "register a governed approver before creating an approval request")
    assert actions[12] == ("none", "provide a valid unified diff before preparing a change context")


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    kept = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffle_files(spark) <= before and kept.count() == 7
    assert spark.conf.get(session.CLEANUP) == "false"


def test_scratch_of_a_block_goes_with_it(spark, tmp_path):
    outer = session.scratch_dir(spark, "outer")
    with session.passing(spark):
        first = session.cut_lineage(spark.range(5))
        with session.passing(spark):
            kept = session.cut_lineage(first.where("id > 2"), outer)
            inner = session.cut_lineage(first)
        assert first.count() == 5
        with pytest.raises(Exception, match="NOT_FOUND|not exist"):
            spark.read.parquet(inner.inputFiles()[0].rpartition("/")[0]).count()
    with pytest.raises(Exception, match="NOT_FOUND|not exist"):
        spark.read.parquet(first.inputFiles()[0].rpartition("/")[0]).count()
    assert kept.count() == 2


def scratch_columns(spark):
    """The columns of each table in the run folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session.run_root(spark))
    folders = [f.getPath().toString() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return {folder: set(spark.read.parquet(folder).columns) for folder in folders}


def test_no_text_of_a_change_stays_in_scratch(spark):
    """Diffs, lines and rebuilt files go when findings are written; hunks stay, in one copy."""
    before = set(scratch_columns(spark))
    changes = spark.createDataFrame(
        [(1, SAFE, True, {"__index__": "r1"}, "p1", None, "repo", "kb")],
        "change_id BIGINT, diff_text STRING, tests_passed BOOLEAN, base_revisions MAP<STRING, STRING>, policy_revision STRING, "
        "context_id STRING, repository_digest STRING, knowledge_digest STRING")
    stored = spark.createDataFrame([(1, "db/a.sql", "BEGIN; UPDATE t SET a = 1; COMMIT;\n")], "change_id BIGINT, path STRING, stored_text STRING")
    assessed = jobs.assess_changes(
        changes, stored, spark.createDataFrame([policy("db", ["db/*"])], REGISTRY), spark.createDataFrame([], "id STRING, dynamic BOOLEAN"),
        spark.createDataFrame([], "edge_id STRING, source_id STRING, target_id STRING, kind STRING"),
        spark.createDataFrame([], "change_id BIGINT, test_id STRING, revision STRING, passed BOOLEAN"),
        spark.createDataFrame([], "item STRING"))
    assert [(r.finding_id, r.violated) for r in assessed["findings"].collect()] == [("db:compare", False)]
    made = [columns for folder, columns in scratch_columns(spark).items() if folder not in before]
    assert not set().union(*made) & {"diff_text", "line", "stored_text", "before_text", "source"}
    assert sum("hunks" in columns for columns in made) == 1


def test_texts_are_shuffled_once_on_their_way_to_the_hunks(spark):
    lines = diffs.diff_lines(spark.createDataFrame([(1, TWO)], "change_id BIGINT, diff_text STRING"))
    plan = diffs.file_hunks(session.cut_lineage(lines))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
