"""Unified diffs as a line table.

A change is placed by its id while it is still one compact row; the lines exploded from it
stay in that partition, so segmenting, counting and fault checks share a single shuffle.
Every group here is the content of one source row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import filters
from tidegate.operators.joins import matching_policies, richest_text
from tidegate.session import cut_lineage

# The hunk header.
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

# Tokens the heuristic baseline looks for.
GUARD_CALL, GUARD_DECORATOR, PROTECTED_CALL = "idempotencystore.check", "@transaction", "ledger.redeem"
FOREIGN_CLIENTS = ("coupon_client", "refund_service")


def diff_lines(changes: DataFrame) -> DataFrame:
    """Lines with file number, hunk number, marker and old/new line numbers.

    file_no is 0 before the first file header; hunk_no is 0 in the header part of a file.
    """
    placed = changes.select("change_id", "diff_text").repartition("change_id")
    lines = placed.select(
        "change_id", F.posexplode(text.split_lines(F.col("diff_text"))).alias("pos", "line")
    )
    upto = Window.partitionBy("change_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts_file = F.col("line").startswith("diff --git ")
    starts_hunk = F.col("line").startswith("@@ ")
    numbered = lines.withColumns({
        "file_no": F.count_if(starts_file).over(upto),
        "hunk_seq": F.count_if(starts_hunk).over(upto),
        "part": F.last(
            F.when(starts_file, "header").when(starts_hunk, "hunk"), ignorenulls=True
        ).over(upto),
    })
    inside = (F.col("file_no") > 0) & (F.col("part") == "hunk")
    body = numbered.withColumn(
        "hunk_no", F.when(inside, F.col("hunk_seq")).otherwise(F.lit(0))
    ).withColumn(
        "marker",
        F.when((F.col("hunk_no") > 0) & ~starts_hunk, F.substring("line", 1, 1)),
    )
    in_hunk = (
        Window.partitionBy("change_id", "file_no", "hunk_no")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    header = F.first(F.when(starts_hunk, F.col("line")), ignorenulls=True).over(in_hunk)
    old_start = F.regexp_extract(header, HUNK_HEADER, 1).try_cast("int")
    new_start = F.regexp_extract(header, HUNK_HEADER, 3).try_cast("int")
    old_side, new_side = F.col("marker").isin(" ", "-"), F.col("marker").isin(" ", "+")
    return body.withColumns({
        "old_no": F.when(old_side, old_start + F.count_if(old_side).over(in_hunk) - 1),
        "new_no": F.when(new_side, new_start + F.count_if(new_side).over(in_hunk) - 1),
    }).drop("hunk_seq", "part")


def header_path(line: Column, marker: str, prefix: str) -> Column:
    """Path of a ``---`` or ``+++`` header without its side prefix."""
    raw = F.split(F.substring(line, len(marker) + 1, 2147483647), "\t")[0]
    return F.when(raw.startswith(prefix), F.substring(raw, len(prefix) + 1, 2147483647))


def _in_header(line_test: Column) -> Column:
    return (F.col("hunk_no") == 0) & line_test


def diff_files(lines: DataFrame) -> DataFrame:
    """One row per file with paths, operation and line counts."""
    line = F.col("line")
    old_header = _in_header(line.startswith("--- "))
    new_header = _in_header(line.startswith("+++ "))
    rolled = lines.where("file_no > 0").groupBy("change_id", "file_no").agg(
        F.max_by(F.when(old_header, header_path(line, "--- ", "a/")), F.when(old_header, F.col("pos")))
        .alias("old_header"),
        F.max_by(F.when(new_header, header_path(line, "+++ ", "b/")), F.when(new_header, F.col("pos")))
        .alias("new_header"),
        F.bool_or(old_header).alias("has_old"),
        F.bool_or(new_header).alias("has_new"),
        F.max(F.when(_in_header(line.startswith("rename from ")), F.substring(line, 13, 2147483647)))
        .alias("rename_from"),
        F.max(F.when(_in_header(line.startswith("rename to ")), F.substring(line, 11, 2147483647)))
        .alias("rename_to"),
        F.count_if(line.startswith("@@ ")).alias("n_hunks"),
        F.count_if(F.col("marker") == "+").alias("n_added"),
        F.count_if(F.col("marker") == "-").alias("n_removed"),
        F.bool_or(F.when(F.col("marker") == "+", filters.has_public_marker(F.substring(line, 2, 2147483647))))
        .alias("marked"),
    )
    renamed = F.col("rename_from").isNotNull() | F.col("rename_to").isNotNull()
    operation = (
        F.when(renamed, "rename")
        .when(F.col("old_header").isNull(), "add")
        .when(F.col("new_header").isNull(), "delete")
        .otherwise("modify")
    )
    return rolled.select(
        "change_id", "file_no",
        F.when(renamed, F.col("rename_from")).otherwise(F.col("old_header")).alias("old_path"),
        F.when(renamed, F.col("rename_to")).otherwise(F.col("new_header")).alias("new_path"),
        operation.alias("operation"), "n_hunks", "n_added", "n_removed",
        F.coalesce("marked", F.lit(False)).alias("marked"),
        "has_old", "has_new", "rename_from", "rename_to",
    )


def diff_faults(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """Every reason a change cannot be parsed safely, one row each; no input aborts the job."""
    # The texts of the faults below, and those of ``reconstruct``.
    line = F.col("line")
    files = diff_files(lines)

    def fault_rows(rows: DataFrame, faults: Column) -> DataFrame:
        return rows.select("change_id", F.explode(F.array_compact(faults)).alias("fault"))

    per_change = lines.groupBy("change_id").agg(F.max("file_no").alias("n_files"))
    whole = fault_rows(
        changes.select("change_id").join(per_change, "change_id", "left"),
        F.array(
            F.when(F.col("n_files").isNull(), "input must be a non-empty unified diff"),
            F.when(F.col("n_files") == 0, "input contains no diff --git file header"),
        ),
    )
    words = F.split(F.trim(line), r"\s+")
    headers = fault_rows(
        lines.where((F.col("file_no") > 0) & (F.col("hunk_no") == 0)),
        F.array(
            F.when(line.startswith("diff --git ") & (F.size(words) != 4), "invalid diff --git header"),
            F.when(
                line.startswith("diff --git ") & (F.size(words) == 4)
                & ~(F.get(words, F.lit(2)).startswith("a/") & F.get(words, F.lit(3)).startswith("b/")),
                "diff --git paths must use a/ and b/ prefixes",
            ),
            F.when(
                line.startswith("GIT binary patch") | line.startswith("Binary files "),
                "binary diffs are not supported",
            ),
            *[
                F.when(
                    line.startswith(marker)
                    & (F.split(F.substring(line, 5, 2147483647), "\t")[0] != "/dev/null")
                    & header_path(line, marker, prefix).isNull(),
                    f"path must use {prefix} prefix",
                )
                for marker, prefix in (("--- ", "a/"), ("+++ ", "b/"))
            ],
        ),
    )
    renamed = F.col("rename_from").isNotNull() | F.col("rename_to").isNotNull()
    complete = F.col("has_old") & F.col("has_new") & (F.col("n_hunks") > 0)
    touched = F.col("has_old") | F.col("has_new") | (F.col("n_hunks") > 0)

    def unsafe(path: str) -> Column:
        return F.coalesce(filters.unsafe_path(F.col(path)), F.lit(False))

    shapes = fault_rows(
        files,
        F.array(
            F.when(
                renamed & (F.col("rename_from").isNull() | F.col("rename_to").isNull()),
                "renames must provide both rename from and rename to",
            ),
            F.when(
                F.col("rename_from").isNotNull() & F.col("rename_to").isNotNull() & touched & ~complete,
                "a rename with content changes needs ---, +++, and at least one @@ hunk",
            ),
            F.when(
                ~renamed & ~complete, "each changed file needs ---, +++, and at least one @@ hunk"
            ),
            F.when(unsafe("old_path") | unsafe("new_path"), "unsafe path"),
        ),
    )
    starts = line.startswith("@@ ")
    hunks = lines.where("hunk_no > 0").groupBy("change_id", "file_no", "hunk_no").agg(
        F.first(F.when(starts, line), ignorenulls=True).alias("header"),
        F.count_if(F.col("marker").isin(" ", "-")).alias("n_old"),
        F.count_if(F.col("marker").isin(" ", "+")).alias("n_new"),
        F.bool_or(~starts & ~F.col("marker").isin(" ", "+", "-", "\\")).alias("odd_line"),
    )

    def declared(group: int) -> Column:
        value = F.regexp_extract("header", HUNK_HEADER, group)
        return F.when(value == "", F.lit(1)).otherwise(value.try_cast("int"))

    well_formed = F.col("header").rlike(HUNK_HEADER)
    bodies = fault_rows(
        hunks,
        F.array(
            F.when(~well_formed, "malformed hunk header"),
            F.when(well_formed & F.col("odd_line"), "unsupported hunk line"),
            F.when(
                well_formed & ~F.col("odd_line")
                & ((declared(2) != F.col("n_old")) | (declared(4) != F.col("n_new"))),
                "truncated hunk",
            ),
        ),
    )
    return (
        whole.unionByName(headers).unionByName(shapes).unionByName(bodies).distinct()
    )


def file_hunks(lines: DataFrame) -> DataFrame:
    """Hunks of each file in order, each with its before and after lines.

    The lines of a file meet once, and its hunks are slices of them.
    """
    bodies = lines.where("hunk_no > 0").groupBy("change_id", "file_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "hunk_no", "line"))).alias("body"))
    starts = F.filter(F.sequence(F.lit(0), F.size("body") - 1), lambda i: F.get("body", i)["line"].startswith("@@ "))
    sliced = bodies.withColumn("starts", starts).select("change_id", "file_no", F.transform("starts", lambda i, n: F.struct(
        F.get("body", i).alias("header"),
        F.slice("body", i + 2, F.coalesce(F.get("starts", n + 1), F.size("body")) - i - 1).alias("body"))).alias("hunks"))

    def side(body: Column, markers: tuple[str, ...]) -> Column:
        kept = F.filter(body, lambda item: F.substring(item["line"], 1, 1).isin(*markers))
        return F.transform(kept, lambda item: F.substring(item["line"], 2, 2147483647))

    def number(header: Column, group: int) -> Column:
        return F.regexp_extract(header["line"], HUNK_HEADER, group).try_cast("int")

    return sliced.select("change_id", "file_no", F.transform("hunks", lambda h: F.struct(
        h["header"]["hunk_no"].alias("hunk_no"), number(h["header"], 1).alias("old_start"), number(h["header"], 3).alias("new_start"),
        side(h["body"], (" ", "-")).alias("before"), side(h["body"], (" ", "+")).alias("after"),
        F.exists(h["body"], lambda item: item["line"].startswith("\\")).alias("no_newline"),
    )).alias("hunks"))


def patched(base: str, hunks: str, reverse: bool = False) -> Column:
    """Lines after applying hunks to ``base``; null when they do not fit.

    A fold over the file's hunks. Each one is taken at its declared line, or at the only
    other place where its lines occur in a row; that place is found by one substring search
    over the joined lines instead of pairing lines. A hunk adds the lines kept before it and its
    own as two pieces, and the pieces become lines once, after the last hunk.
    """
    old, new, start = (
        ("after", "before", "new_start") if reverse else ("before", "after", "old_start")
    )
    sep = r"'\n'"
    found = f"""
        CASE WHEN NOT s.ok THEN NULL
          WHEN greatest(h.{start} - 1, 0) >= s.cursor
            AND slice({base}, greatest(h.{start} - 1, 0) + 1, size(h.{old})) = h.{old}
            THEN greatest(h.{start} - 1, 0)
          WHEN size(h.{old}) = 0 THEN NULL
          ELSE element_at(transform(
            array(named_struct(
              'hay', concat({sep}, array_join(slice({base}, s.cursor + 1, size({base})), {sep}), {sep}),
              'pin', concat({sep}, array_join(h.{old}, {sep}), {sep}))),
            t -> CASE WHEN locate(t.pin, t.hay) > 0
                AND locate(t.pin, t.hay, locate(t.pin, t.hay) + 1) = 0
              THEN s.cursor + locate(t.pin, t.hay) - 1
                - length(replace(substring(t.hay, 1, locate(t.pin, t.hay) - 1), {sep}, '')) END), 1)
        END"""
    step = f"""element_at(transform(array({found}), at ->
        CASE WHEN at IS NULL OR at > size({base})
          THEN named_struct('ok', false, 'cursor', s.cursor, 'out', s.out)
          ELSE named_struct('ok', true, 'cursor', at + size(h.{old}),
            'out', concat(s.out, array(slice({base}, s.cursor + 1, at - s.cursor), h.{new}))) END), 1)"""
    # The newline count above is the number of separators before the match.
    return F.expr(f"""
        aggregate({hunks}, named_struct('ok', true, 'cursor', 0, 'out', cast(array() AS ARRAY<ARRAY<STRING>>)),
          (s, h) -> {step},
          s -> CASE WHEN s.ok THEN
            flatten(concat(s.out, array(slice({base}, s.cursor + 1, greatest(size({base}) - s.cursor, 0))))) END)""")


def stored_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored text behind each file of a change: (change_id, file_no, stored_text).

    ``stored`` has change_id, path and stored_text. The old path is looked up before the new one,
    so a rename is found wherever the file is; a file that is stored nowhere has no row. The place is
    settled without the texts, of which each is shuffled once.
    """
    places = files.select("change_id", "file_no", F.explode(F.array(
        F.struct(F.lit(0).alias("turn"), F.col("old_path").alias("path")),
        F.struct(F.lit(1).alias("turn"), F.col("new_path").alias("path")),
    )).alias("p")).select("change_id", "file_no", "p.turn", "p.path").where("path IS NOT NULL")
    held = stored.groupBy("change_id", "path").agg(F.min("stored_text").alias("stored_text"))
    chosen = places.join(stored.select("change_id", "path").distinct(), ["change_id", "path"]).groupBy("change_id", "file_no").agg(
        F.min_by("path", "turn").alias("path"))
    return chosen.join(held, ["change_id", "path"]).select("change_id", "file_no", "stored_text")


def reconstruct(files: DataFrame, hunks: DataFrame, stored: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Before and after text of each file, whichever of the two is stored.

    ``stored`` has change_id, file_no and stored_text (null when no file exists). ``side``
    tells which state was stored; a fault replaces the texts when neither fits. Columns of ``files``
    that are ``carried`` stand beside the texts, which then need not be shuffled to meet them.
    """
    joined = (
        files.join(hunks, ["change_id", "file_no"], "left")
        .join(stored, ["change_id", "file_no"], "left")
        .withColumn("base", F.when(F.col("operation") == "add", F.array().cast("array<string>"))
                    .otherwise(F.coalesce(text.split_lines(F.col("stored_text")),
                                          F.array().cast("array<string>"))))
        .withColumn("hunks", F.coalesce("hunks", F.expr(
            "cast(array() AS ARRAY<STRUCT<hunk_no: BIGINT, old_start: INT, new_start: INT, "
            "before: ARRAY<STRING>, after: ARRAY<STRING>, no_newline: BOOLEAN>>)")))
    )
    tried = joined.withColumns({
        "forward": patched("base", "hunks"), "backward": patched("base", "hunks", reverse=True),
    })
    op = F.col("operation")
    missing = F.col("stored_text").isNull()
    ends = F.col("stored_text").endswith("\n")
    closed = ~F.exists("hunks", lambda h: h["no_newline"])
    growth = F.col("n_added") > F.col("n_removed")
    both = F.col("forward").isNotNull() & F.col("backward").isNotNull()
    pure = F.size("hunks") == 0
    use_forward = F.col("forward").isNotNull() & ~(both & growth)
    use_backward = F.col("backward").isNotNull() & ~(both & ~growth)

    def as_text(lines: str, newline: Column) -> Column:
        joined_text = F.array_join(lines, "\n")
        return F.when((F.size(lines) > 0) & newline, F.concat(joined_text, F.lit("\n"))).otherwise(
            joined_text
        )

    same_as_disk = text.split_lines(F.col("stored_text")) == F.col("forward")
    side = (
        F.when((op == "add") & F.col("forward").isNotNull(), "added")
        .when(op == "add", F.lit(None).cast("string"))
        .when(missing & (op == "delete") & F.col("backward").isNotNull(), "deleted")
        .when(missing, F.lit(None).cast("string"))
        .when((op == "delete") & (F.size("forward") == 0), "before")
        .when(op == "delete", F.lit(None).cast("string"))
        .when(pure, "both")
        .when(use_forward, "before")
        .when(use_backward, "after")
    )
    sided = tried.withColumn("side", side)
    kind = F.col("side")
    before = (
        F.when(kind == "added", F.lit(""))
        .when(kind == "deleted", as_text("backward", closed))
        .when(kind.isin("before", "both"), F.col("stored_text"))
        .when(kind == "after", as_text("backward", ends))
    )
    after = (
        F.when((kind == "added") & F.coalesce(same_as_disk, F.lit(False)), F.col("stored_text"))
        .when(kind == "added", as_text("forward", closed))
        .when(kind == "deleted", F.lit(""))
        .when(kind.isin("after", "both"), F.col("stored_text"))
        .when((kind == "before") & (op == "delete"), F.lit(""))
        .when(kind == "before", as_text("forward", ends))
    )
    fault = F.when(
        kind.isNull(),
        F.when(op == "add", "new-file hunks do not apply to an empty baseline")
        .when(missing, "repository file exists in neither diff state")
        .when(op == "delete", "delete hunks do not remove the exact repository baseline")
        .otherwise("hunk context matches neither repository diff state"),
    )
    # written, or a filter on the side would move below and apply all hunks again
    return cut_lineage(sided.select(
        "change_id", "file_no", "old_path", "new_path", "operation", "side",
        before.alias("before_text"), after.alias("after_text"), fault.alias("fault"), *carried,
    ), codec="zstd")


def governed_sides(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Which policies validate which side of each file.

    ``globs`` are those of a registry (``joins.policy_globs``). A policy on the old path whose
    artifact kind changed sees the artifact disappear; a policy on the new path compares only
    when both sides are of the same kind.
    """
    sides = files.select("change_id", "file_no", "old_path", "new_path", F.explode(F.array(
        F.struct(F.lit("old").alias("side"), F.col("old_path").alias("at")),
        F.struct(F.lit("new").alias("side"), F.col("new_path").alias("at")),
    )).alias("s")).select("change_id", "file_no", "old_path", "new_path", "s.side", F.col("s.at").alias("path")).where("path IS NOT NULL")
    each = sides.join(matching_policies(sides.select("path"), globs), "path").groupBy(
        "change_id", "file_no", "old_path", "new_path", "policy_id"
    ).agg(
        F.bool_or(F.col("side") == "old").alias("on_old"), F.bool_or(F.col("side") == "new").alias("on_new"),
    )
    same = (
        F.col("on_old") & F.col("on_new")
        & (filters.artifact_kind(F.col("old_path")) == filters.artifact_kind(F.col("new_path")))
    )
    checks = F.array_compact(
        F.array(
            F.when(
                F.col("on_old") & ~same,
                F.struct(F.col("old_path").alias("path"), F.lit("removed").alias("check")),
            ),
            F.when(
                F.col("on_new"),
                F.struct(
                    F.col("new_path").alias("path"),
                    F.when(same, "compare").otherwise("after").alias("check"),
                ),
            ),
        )
    )
    return each.select("change_id", "file_no", "policy_id", F.explode(checks).alias("c")).select(
        "change_id", "file_no", "policy_id", "c.path", "c.check"
    )


def public_contract(files: DataFrame) -> DataFrame:
    return files.select(
        "change_id", "file_no",
        (filters.is_public_path(F.col("old_path")) | filters.is_public_path(F.col("new_path"))
         | F.col("marked")).alias("public_contract"),
    )


def side_text(diff: Column, marker: str) -> Column:
    """Added or removed content of a whole diff, without its file headers."""
    kept = F.filter(
        text.split_lines(diff),
        lambda x: x.startswith(marker) & ~x.startswith(marker * 3),
    )
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 2147483647)), "\n")


def naive_baseline(diff: Column) -> Column:
    """Heuristic outcome from removed and added text alone."""
    removed, added = F.lower(side_text(diff, "-")), F.lower(side_text(diff, "+"))

    def has(value: Column, token: str) -> Column:
        return F.contains(value, F.lit(token))

    return (
        F.when(has(removed, GUARD_CALL) | has(removed, GUARD_DECORATOR), "block")
        .when(has(added, GUARD_CALL) & has(added, PROTECTED_CALL), "tests")
        .when(has(diff, FOREIGN_CLIENTS[0]) | has(diff, FOREIGN_CLIENTS[1]), "approval")
        .otherwise("allow")
    )


def diff_signals(diff: Column) -> Column:
    """Terms of a diff plus contract hints for schema files and numbered fields."""
    terms = text.identifier_terms(diff)
    empty = F.array().cast("array<string>")
    schema = F.when(
        diff.rlike(r"(?m)^--- a/.+\.proto$"), F.array(F.lit("contract"), F.lit("dto"))
    ).otherwise(empty)
    field = F.when(
        diff.rlike(r"(?m)^[-+]\s*\w+\s+\w+\s*=\s*\d+\s*;"), F.array(F.lit("field"))
    ).otherwise(empty)
    return F.array_union(F.array_union(terms, schema), field)


def changed_symbols(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph node each diff changes.

    A new quoted route names itself. Otherwise the node of the changed file with the most
    removed tokens wins, then the shortest id; without any hit the shortest dynamic node.
    File nodes are found by an equi join on the file prefix; schema nodes, which are matched
    across all files, by ``joins.richest_text``.
    """
    path = F.regexp_extract("diff_text", r"(?m)^--- a/(.+)$", 1)
    # read four times, and much smaller than the diffs
    parsed = cut_lineage(changes.select(
        "change_id",
        path.alias("path"),
        F.regexp_extract("diff_text", r"(?m)^\+.*?[\"'](/[^\"']+)[\"']", 1).alias("route"),
        F.array_distinct(
            F.regexp_extract_all(
                side_text(F.col("diff_text"), "-"), F.lit(text.IDENTIFIER_PATTERN), F.lit(0)
            )
        ).alias("tokens"),
    ).withColumns({
        "repo": F.split("path", "/")[0],
        "schema": F.col("path").endswith(".proto"),
    }))
    known = nodes.select(
        "id", "dynamic", F.concat(F.substring_index("id", "#", 1), F.lit("#")).alias("prefix")
    )
    waiting = parsed.where((F.col("path") != "") & (F.col("route") == ""))
    in_file = (
        waiting.where(~F.col("schema"))
        .withColumn("prefix", F.concat(F.lit("repo://"), "path", F.lit("#")))
        .join(known, "prefix")
        .select(
            "change_id", "id", "dynamic",
            F.size(F.filter("tokens", lambda t: F.contains(F.col("id"), t))).cast("long").alias("hits"),
        )
    )
    schemas = known.where(F.col("id").startswith("proto://"))
    in_schemas = richest_text(
        waiting.where("schema").select(F.col("change_id").alias("request_id"), F.col("tokens").alias("terms")),
        schemas.select("id", F.col("id").alias("text")),
    ).select(F.col("request_id").alias("change_id"), "id", F.lit(False).alias("dynamic"), "hits")
    order = F.struct(-F.col("hits"), F.length("id"), F.col("id"))
    shortest = F.struct(F.length("id"), F.col("id"))
    best = in_file.unionByName(in_schemas).groupBy("change_id").agg(
        F.min_by("id", F.when(F.col("hits") > 0, order)).alias("best"),
        F.min_by("id", F.when(F.col("dynamic"), shortest)).alias("fallback"),
    )
    # Schema diffs share one fallback: the shortest dynamic schema node.
    shared = schemas.where("dynamic").agg(F.min_by("id", shortest)).scalar()
    joined = parsed.select("change_id", "path", "route", "repo", "schema").join(best, "change_id", "left")
    node = F.when(
        (F.col("path") != "") & (F.col("route") != ""),
        F.concat(F.lit("unindexed-route://"), "repo", "route"),
    ).otherwise(F.coalesce("best", "fallback", F.when(F.col("schema"), shared)))
    return joined.select(
        "change_id", node.alias("node_id"),
        F.when(F.col("path") == "", "malformed diff").when(
            node.isNull(), "diff has no indexed changed artifact"
        ).alias("fault"),
    )
