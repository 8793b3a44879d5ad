"""Functions, search and order-dependent operators on small inputs."""

from __future__ import annotations

import fnmatch
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.functions import text
from tidegate.operators import artifacts, joins, ordered, vectors
from tidegate.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_identifier_terms(spark):
    assert set(one(spark, text.identifier_terms(F.lit("CouponDTO_id parseHTTPBody x v12 ABC_de")))) == {
        "coupon", "dt", "id", "parse", "http", "body", "12", "ab", "de"}


def test_snake_case_and_suffix(spark):
    assert one(spark, text.snake_case(F.lit("CouponOrderLine"))) == "coupon_order_line"
    assert [one(spark, text.suffix(F.lit(p))) for p in ("a/b.PROTO", "a/.env", "x.tar.gz", "noext", "d.x/y")] == [
        ".proto", "", ".gz", "", ""]


def test_token_estimate_counts_units(spark):
    value = '{"变更":"abcde f_1 !"}'
    units = re.findall(r"[一-鿿]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_一-鿿]", value)
    want = sum(1 if len(u) == 1 else -(-len(u.encode()) // 4) for u in units)
    assert one(spark, text.token_estimate(F.lit(value))) == want


def test_globs_match_like_fnmatch(spark):
    patterns = ["**/*.sql", "*.sql", "a?c[!x].y", "[ab]*", "lit.eral"]
    paths = ["a.sql", "x/y.sql", "x.SQL", "abcd.y", "abcx.y", "b", "literal", "lit.eral", "a\nb.sql"]
    for pattern in patterns:
        regex = re.compile(joins.glob_to_regex(pattern).replace(r"\z", r"\Z"))
        assert [bool(regex.match(p)) for p in paths] == [fnmatch.fnmatchcase(p, pattern) for p in paths]


def test_percentile_case_and_hot_group(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "v DOUBLE")
    got = ordered.exact_percentiles(rows, [], "v", [50.0, 95.0]).first()
    assert (got.p50, got.p95) == pytest.approx((20.0, 29.0))
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", float(rng.choice([5, 5, 5, rng.randrange(1000)]))) for i in range(2000)]
    frame = spark.createDataFrame(data, "k STRING, v DOUBLE")
    for r in ordered.exact_percentiles(frame, ["k"], "v", [1.0, 50.0, 95.0, 100.0], buckets=8).collect():
        values = [v for k, v in data if k == r.k]
        assert (r.p1, r.p50, r.p95, r.p100) == pytest.approx(tuple(np.percentile(values, [1, 50, 95, 100])))


def test_ordered_operators_match_a_plain_window(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice([None, "a", "b"]), rng.randrange(9)) for i in range(600)]
    frame = spark.createDataFrame(rows, "k STRING, seq BIGINT, mark STRING, n INT").withColumn("b", F.expr("seq div 32"))
    order = [F.col("seq")]
    got = ordered.last_before(ordered.ranked(ordered.running_sum(frame, ["k"], "b", order, F.col("n"), "total"),
                                             ["k"], "b", order), ["k"], "b", order, F.col("mark"), "last")
    state = {}
    want = {}
    for k, seq, mark, n in rows:
        count, total, last = state.get(k, (0, 0, None))
        want[seq] = (count + 1, total + n, last)
        state[k] = (count + 1, total + n, mark or last)
    assert {r.seq: (r.position, r.total, r["last"]) for r in got.collect()} == want


def test_term_containment_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda a, b: "".join(rng.choice("abc") for _ in range(rng.randrange(a, b)))
    requests = [(i, list({word(1, 6) for _ in range(4)})) for i in range(12)]
    texts = [(i, word(0, 12)) for i in range(60)]
    got = joins.term_containment(spark.createDataFrame(requests, "request_id INT, terms ARRAY<STRING>"),
                                 spark.createDataFrame(texts, "id INT, text STRING")).collect()
    want = {(r, t): n for r, terms in requests for t, body in texts if (n := sum(x in body for x in terms))}
    assert {(r.request_id, r.id): r.hits for r in got} == want


def test_topk_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 3)
    rng = np.random.default_rng(1)
    base, asked = rng.normal(size=(80, 6)), rng.normal(size=(8, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id BIGINT, query ARRAY<DOUBLE>")
    got = {}
    for r in vectors.topk_vector(frame, queries, 4).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(asked) @ unit(base).T
    assert got == {i: np.argsort(-scores[i])[:4].tolist() for i in range(8)}


def test_sql_and_proto_jobs(spark):
    scripts = spark.createDataFrame([
        (1, "BEGIN; UPDATE t SET a = ');' ; COMMIT"), (2, "UPDATE t SET a = 1 -- begin;"),
        (3, "SELECT (DELETE FROM x); /* drop */ SELECT 1"), (4, "start transaction; drop table x; rollback; drop table y")],
        "id INT, source STRING")
    assert {r.id for r in artifacts.unsafe_scripts(scripts, "id", "source").collect()} == {2, 4}
    proto = ("message A { string name = 1; message B { oneof c { int32 d = 4; } enum E { F = 0; } } "
             "option x = 1; reserved 5; } service S { rpc R (A) returns (A); }")
    got = artifacts.proto_fields(spark.createDataFrame([(1, proto)], "id INT, source STRING"), "id", "source").collect()
    assert {(r.message, r.field, r.number) for r in got} == {("A", "name", 1), ("A.B", "d", 4)}


HEADER = (
    "---\nid: k-1\ntitle: A: b\nscope: s\nowner: o\nsource_uri: repo://s\nsource_revision: r1\n"
    "evidence_uri: repo://e\nconfidence: 0.5\nstatus: draft\n"
)


def test_markdown_files_and_revision_pin(spark, tmp_path):
    (tmp_path / "a.md").write_text(HEADER + "acl: [x, y]\n---\n\nBody\n---\n")
    (tmp_path / "b.md").write_text("no header")
    (tmp_path / "c.md").write_text(HEADER + "acl:\n  - security\n---\n\nBody")
    rows = readers.front_matter(readers.read_texts(spark, str(tmp_path))).orderBy("id", F.desc("content")).collect()
    assert [(r.id, r.title, r.acl, r.content, r.fault) for r in rows] == [
        (None, None, None, None, "knowledge must start with front matter"),
        ("k-1", "A: b", ["x", "y"], "Body\n---", None),
        ("k-1", "A: b", None, "Body", "knowledge acl is not an inline list")]
    edges = spark.createDataFrame([("e", "r1")], "edge_id STRING, revision STRING")
    sinks.write_snapshot(edges, str(tmp_path / "snap"))
    assert readers.read_snapshot(spark, str(tmp_path / "snap"), "r1").count() == 1
    with pytest.raises(readers.IndexLag):
        readers.read_snapshot(spark, str(tmp_path / "snap"), "r2")


def test_registry_rejects_bad_shapes(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"policy_id": "p", "min_samples": "many"}\n')
    with pytest.raises(Exception):
        readers.read_registry(spark, "gates", str(tmp_path / "bad.json")).collect()
