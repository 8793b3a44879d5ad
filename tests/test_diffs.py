"""Diff parsing and patching against a straightforward line walk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidegate.operators import diffs

TWO_FILES = """diff --git a/core/a.proto b/core/a.proto
--- a/core/a.proto
+++ b/core/a.proto
@@ -1,2 +1,2 @@
 message A {
-  int32 old = 1;
+  int32 new = 1;
@@ -9 +9,2 @@
 }
+// end
diff --git a/x.sql b/y.sql
rename from x.sql
rename to y.sql"""


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "change_id INT, diff_text STRING")


def test_files_hunks_and_numbers(spark):
    lines = diffs.diff_lines(frame(spark, [TWO_FILES]))
    files = [(r.file_no, r.old_path, r.new_path, r.operation, r.n_hunks, r.n_added, r.n_removed)
             for r in diffs.diff_files(lines).orderBy("file_no").collect()]
    assert files == [(1, "core/a.proto", "core/a.proto", "modify", 2, 2, 1), (2, "x.sql", "y.sql", "rename", 0, 0, 0)]
    numbers = [(r.marker, r.old_no, r.new_no) for r in lines.where("marker IS NOT NULL").orderBy("pos").collect()]
    assert numbers == [(" ", 1, 1), ("-", 2, None), ("+", None, 2), (" ", 9, 9), ("+", None, 10)]
    assert diffs.diff_faults(frame(spark, [TWO_FILES]), lines).count() == 0


def test_every_fault_is_a_row(spark):
    head = "diff --git a/f b/f\n--- a/f\n+++ b/f\n"
    texts = ["", "hello", "diff --git a/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n x", "diff --git f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n x",
             head, head + "@@ broken @@\n x", head + "@@ -1 +1 @@\nx", head + "@@ -1,3 +1 @@\n x",
             "diff --git a/f b/f\n--- f\n+++ b/f\n@@ -1 +1 @@\n x", "diff --git a/../f b/f\n--- a/../f\n+++ b/f\n@@ -1 +1 @@\n x",
             head + "@@ -0,0 +1 @@\n+x\n\\ No newline at end of file"]
    got = {}
    for r in diffs.diff_faults(frame(spark, texts), diffs.diff_lines(frame(spark, texts))).collect():
        got.setdefault(r.change_id, set()).add(r.fault)
    assert got == {
        0: {"input must be a non-empty unified diff"}, 1: {"input contains no diff --git file header"},
        2: {"invalid diff --git header"}, 3: {"diff --git paths must use a/ and b/ prefixes"},
        4: {"each changed file needs ---, +++, and at least one @@ hunk"}, 5: {"malformed hunk header"},
        6: {"unsupported hunk line"}, 7: {"truncated hunk"}, 8: {"path must use a/ prefix"}, 9: {"unsafe path"}}


def walk(base, hunks, reverse=False):
    old, new, start = ("after", "before", 1) if reverse else ("before", "after", 0)
    out, cursor = [], 0
    for hunk in hunks:
        want, add = hunk[old], hunk[new]
        at = max(hunk["starts"][start] - 1, 0)
        if not (at >= cursor and base[at:at + len(want)] == want):
            spots = [i for i in range(cursor, len(base) - len(want) + 1) if base[i:i + len(want)] == want] if want else []
            if len(spots) != 1:
                return None
            at = spots[0]
        if at > len(base):
            return None
        out += base[cursor:at] + add
        cursor = at + len(want)
    return out + base[cursor:]


def test_patching_matches_line_walk(spark):
    rng = random.Random(11)
    rows, want = [], []
    for case in range(120):
        base = [rng.choice("abcd") for _ in range(rng.randrange(0, 12))]
        hunks, at = [], 0
        for number in range(rng.randrange(1, 4)):
            first = min(len(base), at + rng.randrange(0, 4))
            size = rng.randrange(0, 3)
            before = base[first:first + size]
            after = [x for x in before if rng.random() < 0.6] + ["n"] * rng.randrange(0, 2)
            shift = rng.choice([0, 0, 0, 1, -1])
            hunks.append({"before": before, "after": after, "starts": (max(first + 1 + shift, 0), max(first + 1, 0))})
            at = first + size
        stored = rng.choice([base, ["x", *base], base[1:]])
        structs = [(i, h["starts"][0], h["starts"][1], h["before"], h["after"], False) for i, h in enumerate(hunks)]
        rows.append((case, stored, structs))
        want.append((case, walk(stored, hunks), walk(stored, hunks, reverse=True)))
    data = spark.createDataFrame(rows, "id INT, base ARRAY<STRING>, hunks ARRAY<STRUCT<hunk_no: BIGINT, old_start: INT, "
                                 "new_start: INT, before: ARRAY<STRING>, after: ARRAY<STRING>, no_newline: BOOLEAN>>")
    got = data.select("id", diffs.patched("base", "hunks").alias("f"),
                      diffs.patched("base", "hunks", reverse=True).alias("b")).orderBy("id").collect()
    assert [(r.id, r.f, r.b) for r in got] == want


def test_signals_add_contract_hints(spark):
    text = "--- a/x/Foo.proto\n+  string couponId = 3;\n"
    got = frame(spark, [text]).select(diffs.diff_signals(F.col("diff_text"))).first()[0]
    assert {"contract", "dto", "field", "coupon", "foo", "proto", "string"} <= set(got)


def test_filter_on_the_side_does_not_apply_hunks_again(spark):
    changes = spark.createDataFrame(
        [(1, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,1 +1,1 @@\n-a\n+b")], "change_id BIGINT, diff_text STRING")
    stored = spark.createDataFrame([(1, 1, "a\n")], "change_id BIGINT, file_no BIGINT, stored_text STRING")
    lines = diffs.diff_lines(changes)
    rebuilt = diffs.reconstruct(diffs.diff_files(lines), diffs.file_hunks(lines), stored).where("side IS NOT NULL")
    assert [(r.side, r.before_text, r.after_text) for r in rebuilt.collect()] == [("before", "a\n", "b\n")]
    assert "aggregate(" not in rebuilt._jdf.queryExecution().optimizedPlan().toString()
