"""Impact analysis over a typed dependency graph.

A route starts with a semantic edge and may then use any traversable edge in either
direction until it reaches a business terminal. Because the first edge must be semantic,
every later state is "past the boundary", so the shortest way from a node to a terminal
does not depend on where the walk began. One breadth-first search per terminal (there are
few) therefore serves all changed nodes at once: work grows with terminals x edges instead
of starts x edges. The only exception, a route that would pass through its own start, is
detected and solved exactly by a forward search from those starts.

Equally short routes are ordered by the edge ids along the route. An edge of a node has one
other end, so the least first edge settles it, and a search carries single steps only: by which
edge a node goes on. Nodes and edges are numbered, edges in the order of their ids, so searches
combine whole numbers before each shuffle. Routes are read off the steps at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_lineage, read_levels, scratch_dir

# Edge kinds per impact layer and what counts as a business terminal.
LAYER_KINDS = {
    "L1": ("DECLARES",),
    "L2": ("EXPOSES", "SERIALIZES_TO", "MAPS_TO"),
    "L3": ("CONSUMES", "CALLS", "PUBLISHES", "OBSERVED_CALL"),
    "L4": ("DEPLOYED_WITH",),
    "L5": ("BELONGS_TO_CAPABILITY", "PROTECTED_BY", "OWNED_BY"),
}
SEMANTIC_KINDS = LAYER_KINDS["L2"] + LAYER_KINDS["L3"]
TERMINAL_PREFIXES = ("capability://", "invariant://", "owner://")


def layer_of(kind: Column) -> Column:
    layer = F.when(F.lit(False), F.lit(""))
    for name, kinds in LAYER_KINDS.items():
        layer = layer.when(kind.isin(*kinds), F.lit(name))
    return layer


def is_terminal(node: Column) -> Column:
    return reduce(lambda a, b: a | b, [node.startswith(prefix) for prefix in TERMINAL_PREFIXES])


@dataclass(frozen=True)
class NumberedGraph:
    """Traversable edges by number, written: searches compare and shuffle whole numbers only.

    ``nodes``: id, no. ``edges``: edge_id, no, in the order of edge ids. ``steps``: from ``node`` one
    step to ``other`` by edge ``by``, both directions, all numbers.
    """

    nodes: DataFrame
    edges: DataFrame
    steps: DataFrame


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a number ``no`` that ascends with ``column``; written, so it stays what it is.

    Ranges are dealt in order and sorted within, so the number of a row within its range, behind the
    number of the range, is in the order of the column. It has at most 48 bits with 32,768 ranges.
    """
    placed = rows.repartitionByRange(column).sortWithinPartitions(column)
    return cut_lineage(placed.withColumn("no", F.monotonically_increasing_id()))


def numbered_graph(edges: DataFrame) -> NumberedGraph:
    """Number the traversable edges and their ends; an edge of a node to itself leads nowhere new."""
    kept = numbered(
        edges.where(layer_of(F.col("kind")).isNotNull()).select(
            "edge_id", "source_id", "target_id", F.col("kind").isin(*SEMANTIC_KINDS).alias("semantic")),
        "edge_id",
    )
    ends = kept.select(F.col("source_id").alias("id")).unionByName(kept.select(F.col("target_id").alias("id"))).distinct()
    nodes = numbered(ends, "id")
    source = nodes.select(F.col("id").alias("source_id"), F.col("no").alias("a"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("no").alias("b"))
    pairs = cut_lineage(kept.join(source, "source_id").join(target, "target_id").select(F.col("no").alias("by"), "a", "b", "semantic"))
    ahead = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "by", "semantic")
    back = pairs.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "by", "semantic")
    return NumberedGraph(nodes, kept.select("edge_id", "no"), ahead.unionByName(back))


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


SEARCH = ["terminal", "avoid"]
#: Stands for no node to avoid, and for no edge.
NONE = -1
#: Bits of an edge number; what is above them in a sum is a distance.
EDGE_BITS = 48


def ways(steps: DataFrame, searches: DataFrame) -> DataFrame:
    """Next step of every node on its shortest way to a terminal: (terminal, avoid, node, distance, by, next).

    ``searches`` has a terminal and a node to avoid. Steps go both ways, so what a level finds lies
    in it, the one before or the next: only these two are compared. Each level is written once.
    """
    level = searches.select(*SEARCH, F.col("terminal").alias("node"), F.lit(0).alias("distance"), F.lit(NONE).cast("long").alias("by"))
    links = steps.select("node", "other", "by")
    folders = [scratch_dir(steps.sparkSession, "ways")]
    level = cut_lineage(level, folders[0])
    while True:
        near = read_levels(level, folders[-2:]).select(*SEARCH, "node")
        found = (
            level.select(*SEARCH, F.col("node").alias("other"), "distance").join(links, "other")
            .where("node <> avoid")
            .groupBy(*SEARCH, "node")
            .agg((F.min("distance") + 1).alias("distance"), F.min("by").alias("by"))
            .join(near, [*SEARCH, "node"], "left_anti")
        )
        folder = scratch_dir(steps.sparkSession, "ways")
        level = cut_lineage(found.select(level.columns), folder)
        if _is_empty(level):
            break
        folders.append(folder)
    # an edge and one end give the other end
    return cut_lineage(read_levels(level, folders).join(links.withColumnRenamed("other", "next"), ["node", "by"], "left"))


def follow(ends: DataFrame, preds: DataFrame, graph: NumberedGraph) -> DataFrame:
    """The way from each of ``ends`` (terminal, avoid, node) as arrays of edge ids and node ids, the node itself first.

    A way grows by one row a step; only the finished one becomes a row with arrays, as long as it is.
    """
    onward = preds.where("next IS NOT NULL").select(*SEARCH, "node", "by", "next")
    folders = [scratch_dir(ends.sparkSession, "routes")]
    level = cut_lineage(
        ends.select(*SEARCH, F.col("node").alias("root"), F.lit(0).alias("step"), F.lit(NONE).cast("long").alias("by"), "node"), folders[0])
    while not _is_empty(level):
        further = level.where("node <> terminal").select(*SEARCH, "root", "step", "node").join(onward, [*SEARCH, "node"]).select(
            *SEARCH, "root", (F.col("step") + 1).alias("step"), "by", F.col("next").alias("node"))
        folders.append(scratch_dir(ends.sparkSession, "routes"))
        level = cut_lineage(further, folders[-1])
    named = (
        read_levels(level, folders)
        .join(graph.nodes.select(F.col("no").alias("node"), "id"), "node")
        .join(graph.edges.select(F.col("no").alias("by"), "edge_id"), "by", "left")
    )
    walked = named.groupBy(*SEARCH, F.col("root").alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("step", "edge_id", "id"))).alias("line"))
    return walked.select(
        *SEARCH, "node", F.expr("slice(line.edge_id, 2, size(line) - 1)").alias("edges"), F.col("line.id").alias("nodes"))


def impact_routes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """One shortest route per changed node and reachable terminal."""
    graph = numbered_graph(edges)
    wanted_starts = starts.select(F.col("start").alias("id")).distinct().join(graph.nodes, "id").select(F.col("no").alias("start"))
    exits = wanted_starts.join(graph.steps.where("semantic"), F.col("start") == F.col("node")).where("other <> start").select(
        "start", "other", "by")
    first_name = graph.edges.select(F.col("no").alias("by"), F.col("edge_id").alias("first"))
    names = lambda column: graph.nodes.select(F.col("no").alias(column), F.col("id").alias(f"{column}_id"))

    def routes(searches: DataFrame, wanted: Column) -> DataFrame:
        preds = ways(graph.steps, searches)
        # the least distance, then the least edge, as one number
        offered = exits.join(preds.select(*SEARCH, F.col("node").alias("other"), "distance"), "other").where(wanted)
        best = offered.groupBy("start", *SEARCH).agg(
            F.min(F.shiftleft(F.col("distance").cast("long"), EDGE_BITS) + F.col("by")).alias("best"))
        least = cut_lineage(
            best.select("start", *SEARCH, F.col("best").bitwiseAND(F.lit((1 << EDGE_BITS) - 1)).alias("by"))
            .join(exits.withColumnRenamed("other", "node"), ["start", "by"]))
        # many starts share the rest of their way, and terminals a start: names join before the arrays, of which each is made once
        rest = follow(least.select(*SEARCH, "node").distinct(), preds, graph)
        return cut_lineage(
            least.join(first_name, "by").join(names("start"), "start").join(rest.join(names("terminal"), "terminal"), [*SEARCH, "node"])
            .select(
                "start", "terminal", "start_id", "terminal_id", (F.size("edges") + 1).alias("distance"),
                F.concat(F.array("first"), "edges").alias("edges"), F.concat(F.array("start_id"), "nodes").alias("nodes"),
                F.array_contains("nodes", F.col("start_id")).alias("loops"),
            ))

    shown = lambda found: found.select(
        F.col("start_id").alias("start"), F.col("terminal_id").alias("terminal"), "distance", "edges", "nodes")
    terminals = graph.nodes.where(is_terminal(F.col("id"))).select(F.col("no").alias("terminal"), F.lit(NONE).cast("long").alias("avoid"))
    found = routes(terminals, F.expr("terminal <> start"))
    clean = shown(found.where("NOT loops"))
    looping = found.where("loops").select("terminal", F.col("start").alias("avoid"))
    if _is_empty(looping):
        return clean
    return clean.unionByName(shown(routes(looping, F.expr("avoid = start"))))


def primary_routes(routes: DataFrame) -> DataFrame:
    """The route to the smallest terminal id of each start."""
    columns = ["terminal", "distance", "edges", "nodes"]
    return routes.groupBy("start").agg(
        F.min_by(F.struct(*columns), "terminal").alias("best")
    ).select("start", "best.*")


def unknown_boundaries(starts: DataFrame, routes: DataFrame, nodes: DataFrame, revision: str) -> DataFrame:
    """Starts without a route, with the reason and boundary evidence.

    ``starts`` carries the requested revision; another revision, or a node the graph does
    not hold, is NO_INDEXED_ROUTE.
    """
    known = nodes.select(F.col("id").alias("start"), "dynamic", F.lit(True).alias("indexed"))
    routed = routes.select("start").distinct().withColumn("routed", F.lit(True))
    joined = starts.join(known, "start", "left").join(routed, "start", "left")
    pinned = F.col("indexed").isNotNull() & (F.col("revision") == revision)
    return joined.where(~(pinned & F.coalesce("routed", F.lit(False)))).select(
        "start",
        F.when(pinned & F.col("dynamic"), "DYNAMIC_BOUNDARY").otherwise("NO_INDEXED_ROUTE").alias("reason"),
        F.concat(F.lit("boundary:"), "start").alias("evidence_id"),
        F.concat(F.lit(f"graph://{revision}/nodes/"), "start").alias("evidence_uri"),
    )


def path_evidence(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Evidence of every edge on any route of a start, once per start."""
    used = routes.select("start", F.explode("edges").alias("edge_id")).distinct()
    return used.join(
        edges.select("edge_id", "source", "confidence", "revision", "evidence_uri"), "edge_id"
    )


def path_layers(routes: DataFrame) -> DataFrame:
    """Nodes of a route by impact layer; the start itself opens L1.

    Edge ids begin with their kind, so the layer is read from the route alone.
    """
    steps = routes.select(
        "start", "terminal", F.posexplode("edges").alias("step", "edge_id"), "nodes"
    ).select(
        "start", "terminal", (F.col("step") + 1).alias("step"),
        layer_of(F.substring_index("edge_id", ":", 1)).alias("layer"),
        F.get("nodes", F.col("step") + 1).alias("node"),
    )
    opening = routes.select(
        "start", "terminal", F.lit(0).alias("step"), F.lit("L1").alias("layer"),
        F.col("start").alias("node"),
    )
    return opening.unionByName(steps)


def broken_pairs(paths: DataFrame, edges: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Consecutive path nodes that repeat or are not joined by an edge in either direction."""
    pairs = paths.select(
        "path_id",
        F.posexplode(
            F.zip_with(
                F.slice(nodes, F.lit(1), F.size(nodes) - 1),
                F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))),
                lambda a, b: F.struct(a.alias("left"), b.alias("right")),
            )
        ).alias("step", "pair"),
    ).select("path_id", "step", "pair.left", "pair.right")
    joined = edges.select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    ).distinct()
    loose = (
        pairs.where("left <> right")
        .withColumns({"a": F.least("left", "right"), "b": F.greatest("left", "right")})
        .join(joined, ["a", "b"], "left_anti")
        .select("path_id", "step", F.lit("disconnected").alias("fault"))
    )
    loops = pairs.where("left = right").select("path_id", "step", F.lit("self-loop").alias("fault"))
    return loose.unionByName(loops)


def evidence_completeness(tasks: DataFrame, evidence: DataFrame, unknown: DataFrame, revision: str) -> DataFrame:
    """Per task: whether all evidence is complete and pinned, and whether an expected
    unknown boundary was reported. ``tasks`` has start and expects_unknown."""
    whole = (
        F.col("source").isNotNull() & (F.col("source") != "") & (F.col("confidence") > 0)
        & (F.col("evidence_uri") != "") & (F.col("revision") == revision)
    )
    graded = evidence.groupBy("start").agg(
        F.bool_and(F.coalesce(whole, F.lit(False))).alias("complete")
    )
    reported = unknown.select("start").distinct().withColumn("reported", F.lit(True))
    return tasks.join(graded, "start", "left").join(reported, "start", "left").select(
        "start", "expects_unknown",
        F.coalesce("complete", "reported", F.lit(False)).alias("complete"),
        F.coalesce("reported", F.lit(False)).alias("reported"),
    )


def completeness_summary(graded: DataFrame) -> DataFrame:
    return graded.agg(
        F.count("*").alias("task_count"),
        F.coalesce(F.avg(F.col("complete").cast("double")), F.lit(0.0)).alias("path_evidence_completeness"),
        F.coalesce(
            F.avg(F.when(F.col("expects_unknown"), F.col("reported").cast("double"))), F.lit(1.0)
        ).alias("unknown_boundary_recall"),
    )


def capability_scores(
    signals: DataFrame, terms: DataFrame, policies: DataFrame, tests: DataFrame
) -> DataFrame:
    """Weighted overlap of change signals with capability terms.

    ``terms`` has capability, term and weight; only capabilities with a policy and a test
    can be inferred. Distinct signal terms meet distinct capability terms in an equi join.
    """
    usable = terms.distinct().join(policies, "capability", "left_semi").join(
        tests, "capability", "left_semi"
    )
    return signals.select("change_id", "term").distinct().join(usable, "term").groupBy(
        "change_id", "capability"
    ).agg(F.sum("weight").alias("score"))


def unique_argmax(changes: DataFrame, scores: DataFrame) -> DataFrame:
    """The best capability of each change; ties and zero scores stay unresolved.

    Scores are grouped by value first, so the best one is an aggregate of aggregates.
    """
    tied = scores.where("score > 0").groupBy("change_id", "score").agg(
        F.count("*").alias("n"), F.min("capability").alias("capability")
    )
    best = tied.groupBy("change_id").agg(
        F.max(F.struct("score", "n", "capability")).alias("best")
    )
    status = F.when(F.col("best").isNull(), "no signal").when(F.col("best.n") > 1, "tied").otherwise("ok")
    return changes.select("change_id").join(best, "change_id", "left").select(
        "change_id", status.alias("status"),
        F.when(status == "ok", F.col("best.capability")).alias("capability"),
        F.coalesce("best.score", F.lit(0).cast("long")).alias("score"),
    )


def impact_report(
    starts: DataFrame, routes: DataFrame, unknown: DataFrame, capabilities: DataFrame, tests: DataFrame
) -> DataFrame:
    """Boundary, required tests and approver per changed node, tests in long form.

    ``starts`` has start and capability. The capability owner must approve only when the
    impact ends at an unknown boundary.
    """
    primary = primary_routes(routes).select("start", "terminal", "distance")
    owned = starts.join(capabilities.select("capability", "owner"), "capability", "left")
    required = tests.select("capability", "owner", "policy", "test_id")
    return (
        owned.join(primary, "start", "left")
        .join(unknown.select("start", "reason"), "start", "left")
        .join(required, ["capability", "owner"], "left")
        .select(
            "start", "capability", "terminal", "distance", F.col("reason").alias("unknown_reason"),
            F.when(F.col("reason").isNotNull(), F.col("owner")).alias("required_approver"), "test_id",
        )
    )


def changed_repositories(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Repositories whose content digest differs from the stored one, or is new."""
    return current.join(stored.select("repo", "digest"), ["repo", "digest"], "left_anti")


def build_edges(branches: list[DataFrame]) -> DataFrame:
    """Union fact branches into deduplicated edges.

    Each branch has source_id, target_id, kind, source, evidence_uri; earlier branches win.
    """
    from tidegate.operators.metrics import edge_dedupe

    columns = ["source_id", "target_id", "kind", "source", "evidence_uri"]
    ordered = [
        branch.select(*columns, F.struct(F.lit(i).alias("b"), F.col("evidence_uri").alias("u")).alias("seq"))
        for i, branch in enumerate(branches)
    ]
    union = reduce(DataFrame.unionByName, ordered).withColumn(
        "edge_id", F.concat("kind", F.lit(":"), "source_id", F.lit("->"), "target_id")
    )
    return edge_dedupe(union, "seq")
