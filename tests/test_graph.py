"""Impact routes against a fixed point of least routes."""

from __future__ import annotations

import random

import pytest

from tidegate.operators import graph

LATER = ("DECLARES", "DEPLOYED_WITH", "BELONGS_TO_CAPABILITY", "PROTECTED_BY", "OWNED_BY")


def least_routes(edges, start):
    """Terminal routes of one start as a fixed point: the least (length, edge names) to each state.

    A state is a node and whether an edge that may open a route has been used. Every step is
    tried from every state until nothing gets smaller.
    """
    steps = {(a, b, kind, f"{kind}:{a}->{b}") for kind, a, b in edges}
    steps |= {(b, a, kind, name) for a, b, kind, name in steps}
    least = {(start, False): (0, ())}
    changed = True
    while changed:
        changed = False
        for a, b, kind, name in steps:
            for used in (False, True):
                if b == start or (a, used) not in least or (kind in LATER and not used):
                    continue
                length, names = least[(a, used)]
                reached, offer = (b, used or kind not in LATER), (length + 1, (*names, name))
                if reached not in least or offer < least[reached]:
                    least[reached], changed = offer, True
    ends = ("capability://", "invariant://", "owner://")
    return {node: names for (node, used), (_, names) in least.items() if used and node.startswith(ends)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_routes_match_fixed_point(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)] + ["capability://a", "capability://b", "owner://x"]
    edges = set()
    for _ in range(30):
        kind = rng.choice(["MAPS_TO", "CALLS", "DECLARES", "DEPLOYED_WITH", "OWNED_BY", "BELONGS_TO_CAPABILITY", "READS"])
        edges.add((kind, rng.choice(names), rng.choice(names)))
    kept = [e for e in edges if e[0] != "READS"]
    rows = [(f"{k}:{a}->{b}", a, b, k) for k, a, b in edges]
    frame = spark.createDataFrame(rows, "edge_id STRING, source_id STRING, target_id STRING, kind STRING")
    starts = spark.createDataFrame([(n,) for n in names], "start STRING")
    got = {(r.start, r.terminal): tuple(r.edges) for r in graph.impact_routes(frame, starts).collect()}
    want = {(s, t): route for s in names for t, route in least_routes(kept, s).items()}
    assert got == want


def test_route_never_passes_its_own_start(spark):
    # Through the start the way back would be shorter; it must be avoided.
    edges = [("MAPS_TO", "s", "p"), ("DEPLOYED_WITH", "s", "n"), ("OWNED_BY", "n", "owner://x"),
             ("CALLS", "p", "q"), ("CALLS", "q", "r"), ("OWNED_BY", "r", "owner://x")]
    rows = [(f"{k}:{a}->{b}", a, b, k) for k, a, b in edges]
    frame = spark.createDataFrame(rows, "edge_id STRING, source_id STRING, target_id STRING, kind STRING")
    route = graph.impact_routes(frame, spark.createDataFrame([("s",)], "start STRING")).collect()
    assert [r.nodes for r in route] == [["s", "p", "q", "r", "owner://x"]]


def test_removing_an_edge_changes_the_result(spark):
    rows = [("MAPS_TO:a->b", "a", "b", "MAPS_TO"), ("OWNED_BY:b->owner://x", "b", "owner://x", "OWNED_BY")]
    schema = "edge_id STRING, source_id STRING, target_id STRING, kind STRING"
    start = spark.createDataFrame([("a",)], "start STRING")
    assert graph.impact_routes(spark.createDataFrame(rows, schema), start).count() == 1
    assert graph.impact_routes(spark.createDataFrame(rows[1:], schema), start).count() == 0
