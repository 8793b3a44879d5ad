"""Joins and searches that look at candidates only, against versions that look at everything."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegate import session
from tidegate.operators import approvals, artifacts, context, joins, retrieval
from tidegate.sources import sinks

DOCS = ("id BIGINT, title STRING, content STRING, scope STRING, revision STRING, acl ARRAY<STRING>, status STRING, "
        "expires_at TIMESTAMP_NTZ")
REQUESTS = "request_id BIGINT, query STRING, scope STRING, revision STRING, roles ARRAY<STRING>"


def tokens(text):
    return set(re.findall(r"[\w-]+", text.lower()))


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_search_matches_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(retrieval, "SEED_POSTINGS", 4)
    words = [f"w{i}" for i in range(60)]
    weights = [60 / (i + 1) for i in range(60)]  # some words are in nearly every text
    say = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, say(2), say(rng.choice([0, 3, 10, 40, 200])), rng.choice(["global", "a", "b"]), rng.choice(["r1", "r1", "r2"]),
             rng.choice([["x"], ["y"], ["x", "y"], []]), rng.choice(["published"] * 4 + ["draft"]), None) for i in range(250)]
    docs += [(900, None, None, "a", "r1", ["x"], "published", None), (901, docs[3][1], docs[3][2], *docs[3][3:])]  # empty, equal
    asks = [(i, say(rng.choice([1, 4, 15])), rng.choice("ab"), rng.choice(["r1", "r2"]), [rng.choice("xy")]) for i in range(20)]
    asks += [(50, "nobody says this", "a", "r1", ["x"]), (51, "", "a", "r1", ["x"]), (52, "w1", "c", "r9", ["x"])]
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    limit = 4
    none = spark.createDataFrame([], "request_id BIGINT, id BIGINT, bm25 DOUBLE")
    found = retrieval.hybrid_search(
        spark.createDataFrame(asks, REQUESTS), spark.createDataFrame(docs, DOCS), now, limit, none).collect()
    got = {}
    for r in found:
        got.setdefault(r.request_id, []).append((r.position, r.id, round(r.vector, 12)))
    for request, query, scope, revision, roles in asks:
        scored = []
        for i, title, content, held, pinned, acl, status, _ in docs:
            if status == "published" and held in ("global", scope) and pinned == revision and set(acl) & set(roles):
                a, b = tokens(query), tokens(f"{title or ''} {content or ''}")
                scored.append((-(len(a & b) / math.sqrt(len(a) * len(b))) if a and b else 0.0, i))
        want = [(n, i, round(-s, 12) + 0.0) for n, (s, i) in enumerate(sorted(scored)[:limit], 1)]
        assert sorted(got.get(request, [])) == want, request


def test_scorer_without_bounds_is_asked_for_every_pair(spark):
    docs = spark.createDataFrame([(i, "t", "x " * i, "a", "r1", ["x"], "published", None) for i in range(1, 6)], DOCS)
    asks = spark.createDataFrame([(1, "q", "a", "r1", ["x"])], REQUESTS)
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    found = retrieval.hybrid_search(asks, docs, now, 2, score_tokens=lambda a, b: F.size(b).cast("double")).collect()
    assert [(r.position, r.vector) for r in sorted(found, key=lambda r: r.position)] == [(1, 2.0), (2, 2.0)]


def test_terms_are_found_by_their_rarest_gram(spark):
    rng = random.Random(4)
    texts = [(i, "customer" + "".join(rng.choice("abcde") for _ in range(rng.randrange(8)))) for i in range(300)] + [(900, ""), (901, None), (902, "éa")]
    terms = ["customer", "customera", "customerab", "abc", "a", "ea", "zz", "cust", "", "éa", "customer" * 2]
    requests = spark.createDataFrame([(n, terms[n % 3:] + ["abc"]) for n in range(4)], "request_id BIGINT, terms ARRAY<STRING>")
    got = {(r.request_id, r.id): r.hits for r in joins.term_containment(requests, spark.createDataFrame(texts, "id BIGINT, text STRING")).collect()}
    want = {}
    for n in range(4):
        for i, text in texts:
            hits = sum(1 for t in set(terms[n % 3:] + ["abc"]) if t and t in (text or ""))
            if hits:
                want[n, i] = hits
    assert got == want


def test_common_prefix_is_nobodys_key(spark):
    texts = spark.createDataFrame([(i, f"customer{i:03d}") for i in range(200)], "id BIGINT, text STRING")
    terms = [f"customer{i:03d}" for i in range(0, 200, 9)]
    requests = spark.createDataFrame([(1, terms)], "request_id BIGINT, terms ARRAY<STRING>")
    assert joins.term_containment(requests, texts).count() == 23
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term STRING")
    assert joins.rare_gram_candidates(vocabulary, texts).count() <= 3 * 23


SCHEMAS = {
    "message A { int64 id = 1; message B { string s = 2; oneof o { int32 p = 3; } } optional string t = 4 [x = 9]; }":
        {("A", "id", 1), ("A.B", "s", 2), ("A.B", "p", 3), ("A", "t", 4)},
    "message A { reserved 5; option (x) = { a: 1 }; rpc q = 3; enum E { Z = 0; } map<string, int32> m = 7 }": {("A", "m", 7)},
    "message A { int32 a = 1; } } message B { int32 b = 2; }": {("A", "a", 1), ("B", "b", 2)},
    "int32 a = 1; // message C { int32 z = 9; }": set(),
    "message A { string a = \"2\" ; string b = 3": {("A", "b", 3)},
    "": set(),
}


def test_schema_automaton(spark):
    rows = [(i, text) for i, text in enumerate(SCHEMAS)] + [(90, None)]
    deep = "".join(f"message M{i} {{ " for i in range(60)) + "int32 x = 1; " + "} " * 60
    rows.append((91, deep))
    found = artifacts.proto_fields(spark.createDataFrame(rows, "k BIGINT, source STRING"), "k", "source").collect()
    got = {}
    for r in found:
        got.setdefault(r.k, set()).add((r.message, r.field, r.number))
    for i, want in enumerate(SCHEMAS.values()):
        assert got.get(i, set()) == want, rows[i]
    assert got[91] == {(".".join(f"M{i}" for i in range(60)), "x", 1)}


def test_signatures_count_as_of_their_time(spark):
    rng = random.Random(9)
    approvers, delegates, signed = set(), [], []
    for seq in range(600):
        c = f"c{min(rng.randrange(12), 5)}"
        approvers |= {(c, "a"), (c, "b"), (c, "c")}
        if rng.random() < 0.4:
            delegates.append((c, seq, rng.choice("abc"), rng.choice("abcde")))
        else:
            signed.append((c, seq, rng.choice("abcdef")))
    got = {r.context_id: (r.slots, r.rejected, r.granted_seq) for r in approvals.cosign_counts(
        spark.createDataFrame(signed, "context_id STRING, seq BIGINT, actor STRING"),
        spark.createDataFrame(sorted(approvers), "context_id STRING, approver STRING"),
        spark.createDataFrame(delegates, "context_id STRING, seq BIGINT, approver STRING, delegate STRING"), 2, run=32).collect()}
    want = {}
    for c in {s[0] for s in signed}:
        held, slots, refused, granted = {}, set(), 0, None
        for event in sorted([d for d in delegates if d[0] == c] + [s for s in signed if s[0] == c], key=lambda e: e[1]):
            if len(event) == 4:
                held[event[2]] = event[3]  # a dict keeps the place of the first delegation
                continue
            slot = next((a for a, d in held.items() if d == event[2]), event[2] if event[2] in "abc" else None)
            refused += slot is None
            slots |= {slot} - {None}
            granted = event[1] if granted is None and len(slots) == 2 else granted
        want[c] = (len(slots), refused, granted)
    assert got == want


def test_tasks_without_nodes_or_hints_are_faults(spark):
    nodes = spark.createDataFrame([("repo://shop/a#pay", "pay"), ("repo://shop/b#ship", "ship")], "id STRING, label STRING")
    tasks = spark.createDataFrame(
        [(1, "pay now", ["shop"], []), (2, "pay now", ["nowhere"], []), (3, "pay", ["shop"], ["repo://else"]),
         (4, "pay", ["shop"], ["repo://else", "repo://shop/b#ship"]), (5, "pay", ["shop"], None)],
        "task_id BIGINT, task STRING, repos ARRAY<STRING>, hints ARRAY<STRING>")
    rows = context.symbol_candidates(tasks, nodes).collect()
    faults = {r.task_id: r.fault for r in rows if r.fault}
    assert faults == {2: context.NO_NODES, 3: context.NO_HINTS}
    first = {r.task_id: r.symbol for r in rows if r.position == 1}
    assert first == {1: "repo://shop/a#pay", 4: "repo://shop/b#ship", 5: "repo://shop/a#pay"}


def test_embedder_is_asked_in_calls_of_bounded_size(spark):
    from tidegate.operators import vectors

    def call(texts):
        if len(texts) > 5:
            raise AssertionError("too many texts")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i if i % 7 else None) for i in range(23)], "key BIGINT, content STRING").coalesce(1)
    got = {r.key: list(r.vector) for r in vectors.embed_misses(rows, 2, vectors.calling_embedder(call, 5)).collect()}
    assert got == {i: [float(i if i % 7 else 0), 1.0] for i in range(23)}
    with pytest.raises(Exception, match=vectors.WRONG_COUNT):
        vectors.embed_misses(rows, 2, vectors.calling_embedder(lambda texts: [[1.0]], 5)).collect()


def test_pack_tells_what_it_does_not_know(spark):
    from tidegate.plans import jobs

    nodes = spark.createDataFrame(
        [("repo://shop/a", "pay", True), ("repo://shop/b", "ship", False)], "id STRING, label STRING, dynamic BOOLEAN")
    edges = spark.createDataFrame(
        [("MAPS_TO:repo://shop/b->capability://c", "repo://shop/b", "capability://c", "MAPS_TO")],
        "edge_id STRING, source_id STRING, target_id STRING, kind STRING")
    docs = spark.createDataFrame(
        [(1, "t", "ship it", "global", "r1", ["x"], "published", None, ["p1", "p2"], "u", 0.5)],
        DOCS + ", policy_ids ARRAY<STRING>, source_uri STRING, confidence DOUBLE")
    policies = spark.createDataFrame([("p1", "critical"), ("p2", "critical")], "policy_id STRING, severity STRING")
    tasks = spark.createDataFrame(
        [(1, "ship", "s", "r1", ["x"], ["shop"], []), (2, "pay", "s", "r1", ["x"], ["shop"], []), (3, "zzz", "s", "r1", ["y"], ["shop"], []),
         (4, "ship", "s", "r2", ["x"], ["shop"], []), (5, "ship", "s", "r1", ["x"], ["none"], [])],
        REQUESTS + ", repos ARRAY<STRING>, hints ARRAY<STRING>")
    rows = {r.pack_id: r for r in jobs.context_pack_facts(
        tasks, nodes, edges, docs, policies, F.lit("2024-02-01").cast("timestamp_ntz"), 15, 3, "r1").collect()}
    assert {i: (r.unknowns, r.stale) for i, r in rows.items()} == {
        1: ([], False), 2: (["DYNAMIC_BOUNDARY"], False), 3: (["NO_MATCHING_SYMBOL", "NO_INDEXED_ROUTE"], False),
        4: (["NO_INDEXED_ROUTE"], True), 5: ([], False)}
    assert {i: r.mandatory_policy_recall for i, r in rows.items()} == {1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0, 5: 0.5}
    assert rows[5].fault == context.NO_NODES and rows[1].fault == "mandatory context exceeds token_budget" and rows[3].fault is None


def test_richest_text_is_the_best_row_of_all_pairs(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(f"p://{n}", f"{word(rng.randrange(1, 9))}/{word(rng.randrange(9))}") for n in range(300)]
    requests = [(n, [word(rng.choice([1, 1, 2, 3, 4, 6])) for _ in range(rng.randrange(12))] + ["", "zz"]) for n in range(120)]
    got = joins.richest_text(
        spark.createDataFrame(requests, "request_id BIGINT, terms ARRAY<STRING>"), spark.createDataFrame(texts, "id STRING, text STRING"))
    want = {}
    for request, terms in requests:
        ranked = [(-sum(t in text for t in set(terms) if t), len(text), name) for name, text in texts]
        if min(ranked)[0] < 0:
            want[request] = (min(ranked)[2], -min(ranked)[0])
    assert {r.request_id: (r.id, r.hits) for r in got.collect()} == want


def test_schema_symbols_pair_no_frequent_term_with_every_schema(spark):
    """Requests that share one frequent term and nothing else are one set, and one text stands for all like it."""
    requests = spark.createDataFrame([(n, ["proto"]) for n in range(400)], "request_id BIGINT, terms ARRAY<STRING>")
    texts = spark.createDataFrame([(f"proto://{n:04}", f"proto://{n:04}") for n in range(400)], "id STRING, text STRING")
    best = joins.richest_text(requests, texts)
    assert {(r.id, r.hits) for r in best.collect()} == {("proto://0000", 1)} and best.count() == 400


def rows_made(frame):
    """The most rows that a join or a generator of the finished plan made."""
    most, waiting = 0, [frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        inner = next((name for name in ("executedPlan", "plan", "child") if node.nodeName().startswith(
            {"executedPlan": "AdaptiveSparkPlan", "plan": "ShuffleQueryStage", "child": "ReusedExchange"}[name])), None)
        if node.nodeName().startswith(("BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage")):
            inner = "plan"
        children = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
        if any(kind in node.nodeName() for kind in ("Join", "Generate")):
            most = max(most, node.metrics().apply("numOutputRows").value())
        waiting += children
    return most


def test_no_pair_of_request_and_schema_is_a_row(spark):
    """Requests of frequent terms meet all schemas, but only in the memory of a task."""
    parts = ["ab", "cd", "ef", "gh", "ij", "kl"]
    texts = [(f"t{n:03}", "/".join(p for k, p in enumerate(parts) if n >> k & 1 or k == n % 6) + f"/w{n}") for n in range(250)]
    requests = [(n, [p for k, p in enumerate(parts) if (n * 7) >> k & 1 or k == n % 6] + [f"w{n}", f"x{n}"]) for n in range(250)]
    best = joins.richest_text(
        spark.createDataFrame(requests, "request_id BIGINT, terms ARRAY<STRING>"), spark.createDataFrame(texts, "id STRING, text STRING"))
    got = {r.request_id: (r.id, r.hits) for r in best.collect()}
    want = {}
    for request, terms in requests:
        hits, _, name = min((-sum(t in text for t in terms), len(text), name) for name, text in texts)
        want[request] = (name, -hits)
    assert got == want
    assert rows_made(best) <= 4 * 250


def test_terms_are_found_in_runs_of_any_kind(spark):
    """Runs too long to be cut into substrings, terms across runs, and terms of other characters."""
    long = "x" * 70 + "needle" + "y" * 70
    texts = [(1, f"a://{long}/b"), (2, "naïve_plan-b c"), (3, "😀 ab"), (4, ""), (5, None), (6, "ab\n")]
    terms = ["needle", "xxneedle", long, "ive_p", "b c", "://", "😀 a", "ab", "ab\n", "none", "://x", "b"]
    vocabulary = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term STRING, no BIGINT")
    got = {r.id: r.held for r in joins.run_hits(vocabulary, spark.createDataFrame(texts, "id BIGINT, text STRING")).collect()}
    want = {i: [n for n, t in enumerate(terms) if t in text] for i, text in texts if text}
    assert got == {i: held for i, held in want.items() if held}


def test_parts_of_the_index_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART_CHARACTERS", 100)
    monkeypatch.setattr(retrieval, "PART_POSTINGS", 10)
    rows = [(n, "t", f"one two w{n} " * 8) for n in range(60)] + [(3, "t", "one two w3 " * 8)]  # an identifier twice
    docs = spark.createDataFrame(rows, "id BIGINT, title STRING, content STRING")
    assert retrieval.dealt_by_id(docs).rdd.getNumPartitions() > 40
    found = retrieval.inverted_index(docs)
    assert found.rdd.getNumPartitions() > 40
    assert {(r.term, r.id): r.tf for r in found.collect()} == {
        **{(t, n): 8 * (1 + (n == 3)) for n in range(60) for t in ("one", "two", f"w{n}")}, **{("t", n): 1 + (n == 3) for n in range(60)}}
    asked = spark.createDataFrame([(0, "two w5"), (1, "one two missing")], "request_id BIGINT, query STRING")
    assert [(r.request_id, r.id) for r in retrieval.bm25(asked, docs).collect()] == [(0, 5)]


def test_parts_grow_with_rows(spark, tmp_path, monkeypatch):
    """What a task sorts or groups stays the same when tables grow."""
    monkeypatch.setattr(session, "PART_ROWS", 10)
    monkeypatch.setattr(joins, "CANDIDATE_ROWS", 3)
    nodes = spark.createDataFrame([(f"n{i}", "Code", "x") for i in range(100)], "id STRING, kind STRING, label STRING")
    edges = nodes.select(F.col("id").alias("source_id"), F.lit("n0").alias("target_id"), F.concat(F.lit("e://"), "id").alias("evidence_uri"))
    explained = joins.symbol_evidence(nodes, edges.unionByName(edges))
    assert explained.rdd.getNumPartitions() == 41 and explained.count() == 199
    found = joins.term_containment(
        spark.createDataFrame([(1, ["n1", "9"])], "request_id BIGINT, terms ARRAY<STRING>"), nodes.select("id", F.col("id").alias("text")))
    assert found.rdd.getNumPartitions() > 4 and sum(r.hits for r in found.collect()) == 11 + 19
    sinks.write_snapshot(edges.withColumn("revision", F.lit("r1")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100 and len(list((tmp_path / "s" / "revision=r1").glob("*.parquet"))) > 8


def test_long_literals_of_schemas_are_read(spark):
    source = 'message A { string s = 1 [default = "' + "x\\\"" * 50_000 + '"]; int64 id = 2; }'
    got = artifacts.proto_fields(spark.createDataFrame([(1, source)], "k BIGINT, source STRING"), "k", "source").collect()
    assert {(r.message, r.field, r.number) for r in got} == {("A", "s", 1), ("A", "id", 2)}


def test_candidates_of_alike_nodes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab_-1") for _ in range(rng.randrange(1, 4)))
    nodes = sorted({(f"repo://r{n % 3}/{rng.choice(['test/', ''])}{n}", f"{word()}{rng.choice(' .')}{word()}") for n in range(400)})
    tasks = [(n, " ".join(word() for _ in range(5)), [f"r{n % 3}"], ["repo://r1/4"] if n == 4 else []) for n in range(30)]
    got = {}
    for r in context.symbol_candidates(
            spark.createDataFrame(tasks, "task_id BIGINT, task STRING, repos ARRAY<STRING>, hints ARRAY<STRING>"),
            spark.createDataFrame(nodes, "id STRING, label STRING")).orderBy("task_id", "position").collect():
        got.setdefault(r.task_id, []).append((r.symbol, round(r.confidence or 0, 9), r.fault))
    token = re.compile(r"[\w-]+")
    for task_id, task, repos, hints in tasks:
        terms, scored = set(token.findall(task)), []
        for i, label in nodes:
            if repos[0] in i:
                text = f"{i} {label}".lower()
                hits = sum(t in text for t in terms)
                semantic = len(terms & set(token.findall(text))) / (len(terms) * len(set(token.findall(text)))) ** 0.5
                quality = 2 + ("/test/" not in i) + ("." in label)
                hinted = i in hints
                confidence = 1.0 if hinted else min(0.95, hits / len(terms) + 0.35 * semantic)
                scored.append((-(100 * hinted + hits + semantic), -quality, i, round(confidence, 9)))
        best = sorted(scored)[:3]
        if hints and best[0][2] not in hints:
            assert [f for _, _, f in got[task_id]] == [context.NO_HINTS]
            continue
        kept = best if 0 < best[0][3] < context.CERTAIN_CONFIDENCE else best[:1]
        if best[0][3]:
            assert [s for s, _, _ in got[task_id]] == [b[2] for b in kept], task_id
        assert {c for _, c, _ in got[task_id]} == {best[0][3]}
    read = context.held_terms(
        spark.createDataFrame([("pay-now 12",), ("none",)], "text STRING"), spark.createDataFrame([("pay",), ("12",), ("1",)], "term STRING"))
    assert {(r.text, r.n_tokens, tuple(r.held), tuple(r.named)) for r in read.collect()} == {
        ("pay-now 12", 2, ("1", "12", "pay"), ("12",)), ("none", 1, (), ())}


def test_index_reads_joined_words_as_tokens_and_as_terms(spark):
    from tidegate.operators import retrieval

    rng = random.Random(3)
    body = lambda: "".join(rng.choice("ab _-A.") for _ in range(rng.randrange(60)))
    docs = [(n, body(), body()) for n in range(80)]
    requests = [(n, body()) for n in range(6)]
    index = retrieval.text_index(
        spark.createDataFrame(requests, "request_id BIGINT, query STRING"),
        spark.createDataFrame(docs, "id BIGINT, title STRING, content STRING"))
    find = lambda pattern, text: re.findall(pattern, text.lower())
    of = {kind: {i: find(p, f"{t} {c}") for i, t, c in docs} for kind, p in (("term", "[a-z]+"), ("token", "[a-z_-]+"))}
    asked = {kind: {w for _, q in requests for w in find(p, q)} for kind, p in (("term", "[a-z]+"), ("token", "[a-z_-]+"))}
    assert {tuple(r) for r in index.documents.select("id", "dl", "n_tokens").collect()} == {
        (i, len(of["term"][i]), len(set(of["token"][i]))) for i, _, _ in docs}
    assert sorted(tuple(r) for r in index.terms.select("term", "id", "dl", "tf").collect()) == sorted(
        (w, i, len(ws), ws.count(w)) for i, ws in of["term"].items() for w in set(ws) & asked["term"])
    assert sorted(tuple(r) for r in index.tokens.select("token", "id").collect()) == sorted(
        (w, i) for i, ws in of["token"].items() for w in set(ws) & asked["token"])
    # a word asked both ways is written once
    written = index.terms.sparkSession.read.parquet(*index.terms.inputFiles())
    assert written.groupBy("id", "word").count().where("count > 1").isEmpty()
