"""Registry joins. Sizes decide the strategy: nothing here forces a broadcast, Spark uses
one only where the measured side is below its own threshold, and adaptive execution splits
a skewed side otherwise."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import ids, text
from tidegate.session import cut_lineage, parts_of


def required_tests(requests: DataFrame, capabilities: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests matching the capability, the policy and the capability's owner."""
    owned = requests.join(capabilities.select("capability", "owner"), "capability")
    return owned.join(tests, ["capability", "policy", "owner"])


def contract_coverage(changed_paths: DataFrame, contracts: DataFrame) -> DataFrame:
    """Distinct policies of the contracts a change touches."""
    touched = changed_paths.select("change_id", "path").distinct()
    return (
        touched.join(contracts.select(F.col("source").alias("path"), "policy_ids"), "path")
        .select("change_id", F.explode("policy_ids").alias("policy_id"))
        .distinct()
    )


def uncovered_changes(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    return changes.join(coverage, "change_id", "left_anti")


def resolve_calls(calls: DataFrame, fields: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges from receiver.method() calls; calls that do not resolve are dropped.

    Calls are reduced to their distinct coordinates first, so repeated calls do not travel.
    """
    wanted = calls.select("repo", "owner", "container", "receiver", "name").distinct()
    typed = wanted.join(
        fields.select("repo", "owner", F.col("name").alias("receiver"), "type_name"),
        ["repo", "owner", "receiver"],
    )
    sources = methods.select(
        "repo", "owner", F.col("name").alias("container"), F.col("node_id").alias("source_id")
    )
    targets = methods.select(
        "repo", F.col("owner").alias("type_name"), "name", F.col("node_id").alias("target_id")
    )
    return (
        typed.join(sources, ["repo", "owner", "container"])
        .join(targets, ["repo", "type_name", "name"])
        .select("source_id", "target_id")
        .distinct()
    )


def entity_columns(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """Column nodes and MAPS_TO edges for the fields of entity classes."""
    kept = fields.join(entities, ["repo", "owner"], "left_semi")
    table, column = text.snake_case(F.col("owner")), text.snake_case(F.col("name"))
    return kept.select(
        F.col("node_id").alias("source_id"),
        ids.db_id(F.col("repo"), table, column).alias("target_id"),
        F.concat(table, F.lit("."), column).alias("label"),
    )


def unknown_references(references: DataFrame, known: DataFrame) -> DataFrame:
    """References ``kind:id`` of governed kinds that no registry holds."""
    parsed = references.withColumns({
        "kind": F.split("reference", ":", 2)[0],
        "ref_id": F.split("reference", ":", 2)[1],
    }).where(F.col("kind").isin("registry", "knowledge"))
    return parsed.select("kind", "ref_id").distinct().join(known, ["kind", "ref_id"], "left_anti")


def glob_to_regex(pattern: str) -> str:
    """Case-sensitive glob as an anchored regex; ``*`` also crosses ``/``."""
    out = []
    i = 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append(re.escape(char))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


#: Characters that end the literal run of a glob.
GLOB_SIGNS = "*?["


def glob_anchor(pattern: str) -> tuple[str, str]:
    """The longer literal run at either end of a glob, as ``("start" or "end", run)``."""
    first = next((i for i, c in enumerate(pattern) if c in GLOB_SIGNS), len(pattern))
    # behind the last sign; a bracket hides where its set ends, so only what is behind "]" is literal
    last = max((i for i, c in enumerate(pattern) if c in GLOB_SIGNS + "]"), default=-1) + 1
    start, end = pattern[:first], pattern[last:]
    return ("start", start) if len(start) > len(end) else ("end", end)


def policy_globs(registry: DataFrame) -> DataFrame:
    """(policy_id, glob, regex, anchor, literal) of a registry with id and file_patterns, one row a glob."""

    @F.udf("struct<regex: string, anchor: string, literal: string>")
    def compiled(pattern: str):
        anchor, literal = glob_anchor(pattern)
        return glob_to_regex(pattern), anchor, literal

    globs = registry.select(F.col("id").alias("policy_id"), F.explode("file_patterns").alias("glob")).distinct()
    return cut_lineage(globs.withColumn("c", compiled("glob")).select("policy_id", "glob", "c.*"))


def matching_policies(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, policy_id) for each distinct path and each policy with a glob that matches, case-sensitive.

    An equi join on the literal run that a glob begins or ends with: a path is looked up by its
    own first and last characters, in the lengths that the registry has, and only then is the
    glob compiled and tried. The registry is a table; a new row needs no code.
    """
    # as many lengths as paths have characters, whatever the number of globs
    lengths = [
        (r["anchor"], r["size"])
        for r in globs.select("anchor", F.length("literal").alias("size")).distinct().collect()
    ]
    distinct = paths.select("path").distinct().withColumn("norm", F.replace("path", F.lit("\\"), F.lit("/")))
    keys = [
        F.when(F.length("norm") >= size, F.struct(
            F.lit(anchor).alias("anchor"),
            (F.left("norm", F.lit(size)) if anchor == "start" else F.right("norm", F.lit(size))).alias("literal"),
        )) for anchor, size in lengths
    ]
    none = F.expr("cast(array() AS ARRAY<STRUCT<anchor: STRING, literal: STRING>>)")
    probes = distinct.select("path", "norm", F.explode(F.array_compact(F.array(*keys)) if keys else none).alias("k")).select(
        "path", "norm", "k.anchor", "k.literal")
    return probes.join(globs, ["anchor", "literal"]).where(F.rlike("norm", F.col("regex"))).select("path", "policy_id").distinct()


def grams(value: Column, size: int) -> Column:
    """Distinct substrings of a fixed length."""
    count = F.length(value) - F.lit(size - 1)
    return F.when(
        count > 0,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), count), lambda i: F.substring(value, i, F.lit(size))
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def term_containment(requests: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """How many of a request's terms occur as substrings of each text.

    ``requests`` has request_id and terms, ``texts`` has id (unique) and text. A text that holds
    a term holds all its grams, so each term is looked up by the one that fewest texts hold; a
    prefix that many terms share is nobody's key. Only identifiers stand in the index, and a
    long list meets its terms in an inner join that adaptive execution can split; the text is
    fetched once for each candidate and the substring test verifies it. Terms shorter than a gram
    use grams of their own length.
    """
    terms = asked_terms(requests)
    return (
        term_hits(terms.select("term").distinct(), texts, gram)
        .join(terms, "term")
        .groupBy("request_id", "id")
        .agg(F.count("*").alias("hits"))
    )


def asked_terms(requests: DataFrame) -> DataFrame:
    return requests.select("request_id", F.explode(F.array_distinct("terms")).alias("term")).where(F.col("term") != "")


def term_hits(vocabulary: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """(id, term) for every term of ``vocabulary`` that occurs in a text."""
    candidates = rare_gram_candidates(vocabulary, texts, gram)
    return candidates.join(texts.select("id", "text"), "id").where(F.contains("text", F.col("term"))).select("id", "term")


#: Characters that words are made of. A term of such characters occurs in a text where it occurs in one of its runs.
RUN = text.LEXICAL_PATTERN
#: Runs up to this length are looked up by their substrings; of longer ones there are too many.
RUN_CHARACTERS = 64


def run_hits(vocabulary: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """(id, held): the numbers of the terms that occur in each text, sorted; a text without a term has no row.

    ``vocabulary`` has term and its number no. Texts share most runs of word characters, and each run is looked up once, by its
    substrings, so rows grow with distinct runs whatever the number of terms. Longer runs, and terms of other
    characters, are found by ``term_hits``.
    """
    plain = F.rlike("term", F.lit(rf"\A{RUN}\z"))
    spread = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("run"))
    runs = cut_lineage(spread.select("run").distinct())
    pieces = F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(
        F.sequence(F.lit(1), F.length("run") - i + 1), lambda n: F.substring("run", i, n)))
    found = [
        runs.where(F.length("run") <= RUN_CHARACTERS).select("run", F.explode(F.array_distinct(F.flatten(pieces))).alias("term"))
        .join(vocabulary.where(plain), "term").select("run", "no")
    ]
    long = runs.where(F.length("run") > RUN_CHARACTERS).select(F.col("run").alias("id"), F.col("run").alias("text"))
    if long.take(1):
        found.append(term_hits(vocabulary.where(plain).select("term"), long, gram).join(vocabulary, "term").select(
            F.col("id").alias("run"), "no"))
    by_run = cut_lineage(reduce(DataFrame.unionByName, found).groupBy("run").agg(F.collect_list("no").alias("terms")))
    met = spread.join(by_run, "run").select("id", "terms")
    other = vocabulary.where(~plain).select("term")
    if other.take(1):
        met = met.unionByName(term_hits(other, texts, gram).join(vocabulary, "term").select("id", F.array("no").alias("terms")))
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("held"))


#: Postings that the rarest terms of a request may bring for its first bound.
SEED_POSTINGS = 1024
#: Requests and classes of texts that a task compares at once, on average.
SET_ROWS, CLASS_ROWS = 4096, 1 << 17


class TermLists:
    """Classes of texts by the terms they hold, as arrays: ``rows`` by term and the terms of each row."""

    def __init__(self, held: pa.Table) -> None:
        self.names = np.sort(held["no"].to_numpy())
        lists = held["held"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.searchsorted(self.names, held["no"].to_numpy()), sizes)
        self.terms, term = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        by_term, by_row = np.argsort(term, kind="stable"), np.argsort(row, kind="stable")
        self.rows, self.starts = row[by_term], np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.terms)))))
        self.held, self.ends = term[by_row], np.cumsum(np.bincount(row, minlength=len(self.names)))
        self.asked = np.zeros(len(self.terms), "int64")

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Places of ``terms`` here, -1 of those that no row holds."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def meeting(self, terms: np.ndarray, least: int) -> np.ndarray:
        """Rows that hold at least so many of ``terms``."""
        met = np.concatenate([self.rows[self.starts[t]:self.starts[t + 1]] for t in terms.tolist()])
        if len(met) < len(self.names) // 16:
            rows, shared = np.unique(met, return_counts=True)
            return rows[shared >= least]
        return np.flatnonzero(np.bincount(met) >= least)

    def count(self, rows: np.ndarray) -> np.ndarray:
        """How many asked terms each of ``rows`` holds; a row here holds one term at least."""
        sizes = self.ends[rows] - np.where(rows > 0, self.ends[rows - 1], 0)
        first = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.asked[self.held[np.arange(sizes.sum()) + np.repeat(self.ends[rows] - sizes - first, sizes)]], first)

    def best(self, terms: np.ndarray) -> tuple[int, int]:
        """(hits, row): the first row of those that hold most of ``terms`` (places, not empty).

        The rarest terms bring rows and the best of them a bound. A row that holds as many shares ``least`` of the
        terms without the ``bound - least`` most frequent ones; only such rows are counted.
        """
        sizes = self.starts[terms + 1] - self.starts[terms]
        terms = terms[np.argsort(sizes, kind="stable")]
        self.asked[terms] = 1
        seeds = self.meeting(terms[:max(1, int(np.searchsorted(np.cumsum(np.sort(sizes)), SEED_POSTINGS, "right")))], 1)
        bound = int(self.count(seeds).max())
        least = -(-bound // 3)
        rows = self.meeting(terms[:len(terms) - bound + least], least)
        hits = self.count(rows)
        self.asked[terms] = 0
        at = int(hits.argmax())
        return int(hits[at]), int(rows[at])


def richest_rows(asked: pa.Table, held: pa.Table) -> pa.Table:
    """(set_no, no, hits): for each set of ``asked`` the first class of ``held`` among those that hold most of its terms."""
    out: tuple = ([], [], [])
    if asked.num_rows and held.num_rows:
        lists, sets = TermLists(held), asked["asked"].combine_chunks()
        places = lists.numbers(sets.flatten().to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))
        for set_no, terms in zip(asked["set_no"].to_pylist(), np.split(places, ends[:-1])):
            terms = terms[terms >= 0]
            if len(terms):
                hits, row = lists.best(terms)
                for column, value in zip(out, (set_no, int(lists.names[row]), hits)):
                    column.append(value)
    return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("set_no", "no", "hits"), out)})


def richest_text(requests: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """(request_id, id, hits): the text that holds most terms of each request, then the shortest, then the least id.

    The best row of ``term_containment`` without its pairs, of which frequent terms make one for each
    request and text. Texts that hold the same terms, and requests for the same ones, are
    compared once. Sets and classes meet in blocks: a task reads one part of either, finds the best class of each set
    through lists of terms in memory, and hands on nothing else, so no pair is ever a row.
    """
    terms = asked_terms(requests)
    vocabulary = cut_lineage(terms.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))
    # the terms of a text are substrings of it
    smallest = F.struct(F.length("text").alias("size"), "id")
    alike = cut_lineage(
        run_hits(vocabulary, texts, gram).join(texts.select("id", "text"), "id")
        .groupBy("held").agg(F.min(smallest).alias("best")).select("best.*", "held"))
    # classes are numbered in the order of their best texts
    classes = cut_lineage(
        alike.repartitionByRange("size", "id").sortWithinPartitions("size", "id").withColumn("no", F.monotonically_increasing_id()))
    met = classes.select(F.explode("held").alias("no")).distinct()
    known = cut_lineage(
        terms.join(vocabulary.join(met, "no", "left_semi"), "term").groupBy("request_id").agg(F.array_sort(F.collect_list("no")).alias("asked")))
    sets = cut_lineage(known.select("asked").distinct().withColumn("set_no", F.monotonically_increasing_id()))
    blocks, parts = sets.count() // SET_ROWS + 1, classes.count() // CLASS_ROWS + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    left = sets.select(own("set_no", blocks).alias("block"), every(parts).alias("part"), "set_no", "asked")
    right = classes.select(every(blocks).alias("block"), own("no", parts).alias("part"), "no", "held")
    # few bytes make much work: every pair of parts is a partition of its own, which adaptive execution leaves apart
    dealt = lambda rows: rows.repartition(blocks * parts, "block", "part").groupBy("block", "part")
    best = dealt(left).cogroup(dealt(right)).applyInArrow(richest_rows, "set_no BIGINT, no BIGINT, hits BIGINT")
    first = best.groupBy("set_no").agg(F.min_by(F.struct("no", "hits"), F.struct(-F.col("hits"), F.col("no"))).alias("best"))
    named = first.select("set_no", "best.*").join(classes.select("no", "id"), "no").join(sets, "set_no").select("asked", "id", "hits")
    return known.join(named, "asked").select("request_id", "id", "hits")


#: Index rows whose candidates make a part.
CANDIDATE_ROWS = 1 << 17


def rare_gram_candidates(vocabulary: DataFrame, texts: DataFrame, gram: int = 3) -> DataFrame:
    """(id, term) where the text holds the rarest gram of the term."""
    own = F.when(F.length("term") >= gram, grams(F.col("term"), gram)).otherwise(F.array("term"))
    probes = vocabulary.select("term", F.explode(own).alias("gram"))
    pieces = F.flatten(F.array(*[grams(F.col("text"), n) for n in range(1, gram + 1)]))
    index = cut_lineage(
        texts.select("id", F.explode(pieces).alias("gram")).join(probes.select("gram").distinct(), "gram", "left_semi"))
    lists = index.groupBy("gram").agg(F.count("*").alias("df"))
    # a term with a gram that no text holds has no hit
    rarest = (
        probes.join(lists, "gram", "left").groupBy("term")
        .agg(F.bool_and(F.col("df").isNotNull()).alias("possible"), F.min_by("gram", F.struct("df", "gram")).alias("gram"))
        .where("possible")
    )
    # what follows sorts and groups by id, an index row meeting several terms, each of several requests
    return index.join(rarest.select("term", "gram"), "gram").select("id", "term").repartition(parts_of(index, CANDIDATE_ROWS), "id")


def symbol_evidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence URIs of all edges that touch a node on either end, one row each."""
    ends = edges.select(F.col("source_id").alias("id"), "evidence_uri").unionByName(
        edges.select(F.col("target_id").alias("id"), "evidence_uri")
    )
    return nodes.select("id", "kind", "label").join(ends.repartition(parts_of(ends), "id").distinct(), "id")


def business_overlay(
    capabilities: DataFrame, memberships: DataFrame, services: DataFrame, invariants: DataFrame
) -> DataFrame:
    """Edges that tie deployed services, capabilities, owners and invariants together.

    ``capabilities`` has capability_id, owner_id and in_graph; only selected ones count.
    """
    chosen = capabilities.where("in_graph")
    deployed = (
        memberships.join(chosen.select("capability_id"), "capability_id")
        .join(services, "service_id", "left_semi")
        .select(
            F.col("service_id").alias("source_id"), F.col("capability_id").alias("target_id"),
            F.lit("BELONGS_TO_CAPABILITY").alias("kind"),
        )
    )
    owned = chosen.select(
        F.col("capability_id").alias("source_id"), F.col("owner_id").alias("target_id"),
        F.lit("OWNED_BY").alias("kind"),
    )
    guarded = invariants.join(chosen.select("capability_id"), "capability_id")
    inward = guarded.select(
        F.col("invariant_id").alias("source_id"), F.col("capability_id").alias("target_id"),
        F.lit("BELONGS_TO_CAPABILITY").alias("kind"),
    )
    outward = guarded.select(
        F.col("capability_id").alias("source_id"), F.col("invariant_id").alias("target_id"),
        F.lit("PROTECTED_BY").alias("kind"),
    )
    return deployed.unionByName(owned).unionByName(inward).unionByName(outward)


def context_drift(
    contexts: DataFrame, prepared: DataFrame, discovered: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Findings about a prepared context: stale digests, lost tests, added requirements.

    ``prepared`` and ``discovered`` are (context_id, role, item) rows, ``catalog`` lists the
    test items that still exist; ``contexts`` has the digest pair.
    """
    stale = contexts.where(F.col("prepared_digest") != F.col("current_digest")).select(
        "context_id", F.lit("context:STALE_CONTEXT").alias("finding")
    )
    lost = (
        prepared.where("role = 'test'")
        .join(catalog.select("item"), "item", "left_anti")
        .select("context_id")
        .distinct()
    )
    added = (
        discovered.select("context_id", "role", "item")
        .distinct()
        .join(prepared.select("context_id").distinct(), "context_id", "left_semi")
        .join(prepared, ["context_id", "role", "item"], "left_anti")
        .select("context_id")
        .distinct()
        .join(lost, "context_id", "left_anti")
    )
    return (
        stale.unionByName(lost.withColumn("finding", F.lit("context:CONTEXT_DRIFT")))
        .unionByName(added.withColumn("finding", F.lit("context:CONTEXT_EXPANDED")))
    )


def resolve_base_path(changed: DataFrame, files: DataFrame, root: str, repositories: DataFrame) -> DataFrame:
    """Existing file behind each changed path, else the first candidate.

    Candidates in order: the path itself, the part below the root folder, and the tail from
    every segment that names a repository.
    """
    parts = F.split("path", "/")
    segments = changed.select("path").distinct().withColumn("segments", parts)
    tails = segments.select(
        "path", "segments", F.posexplode("segments").alias("pos", "repository")
    ).join(repositories, "repository", "left_semi").select(
        "path",
        (F.col("pos") + 2).alias("priority"),
        F.array_join(F.slice("segments", F.col("pos") + 1, F.size("segments")), "/").alias("candidate"),
    )
    marker = F.array_position("segments", root)
    below = segments.where(marker > 0).select(
        "path", F.lit(1).alias("priority"),
        F.array_join(
            F.slice("segments", (marker + 1).cast("int"), F.size("segments")), "/"
        ).alias("candidate"),
    )
    itself = segments.select("path", F.lit(0).alias("priority"), F.col("path").alias("candidate"))
    candidates = itself.unionByName(below).unionByName(tails)
    known = files.select(F.col("path").alias("candidate"), F.lit(False).alias("missing")).distinct()
    graded = candidates.join(known, "candidate", "left").withColumn(
        "missing", F.coalesce("missing", F.lit(True))
    )
    order = F.struct("missing", "priority")
    return graded.groupBy("path").agg(
        F.min_by("candidate", order).alias("base_path"),
        F.min_by(~F.col("missing"), order).alias("found"),
    )


def golden_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected key/value rows the actual side does not reproduce.

    List items are keyed by position, so an expected list matches any longer actual list
    that starts with it.
    """
    got = actual.select("case_id", "key", F.col("value").alias("actual"))
    return expected.join(got, ["case_id", "key"], "left").where(
        ~F.col("value").eqNullSafe(F.col("actual"))
    )
