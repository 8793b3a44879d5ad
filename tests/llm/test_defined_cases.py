"""Cases whose result the docstrings define: repeated rows, equal identifiers, clashing names, odd texts in the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from tidegate.llm import bpe, exact_dedup, exact_search, line_dedup, minhash, packing, quality, secrets

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHES = ("n_tokens ids decoded spans kept keep_id group_size component_id n_shingles score held_out predicted stats "
           "piece start length offset sequence_id digest n_lines").split()
TEXTS = ["token = abcdef12 here", "token = abcdef12 here", None, "", "one two three four five six", "one two three four five six"]


def clashing(spark, texts, ids=None):
    """Documents whose further columns are named like everything the operators make."""
    rows = [(i if ids is None else ids[n], t, *["clash"] * len(CLASHES)) for n, (i, t) in enumerate(zip(range(len(texts)), texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def test_repeated_rows_are_answered_each(spark):
    docs = clashing(spark, TEXTS)
    twice = docs.unionByName(docs)
    for answer in (
        lambda d: bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
        secrets.scan,
        lambda d: packing.cut_pieces(d, public_tokenizers.path("byte_bpe_50k.json"), 4),
    ):
        once, both = (Counter(map(str, answer(d).collect())) for d in (docs, twice))
        assert both == Counter({row: 2 * n for row, n in once.items()})
    packed = packing.pack_documents(twice, public_tokenizers.path("byte_bpe_50k.json"), 8).collect()
    places = {(r.sequence_id, r.offset) for r in packed}
    assert len(places) == len(packed) == 2 * packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 8).count()


def test_scores_of_repeated_rows_and_clashing_names(spark):
    docs = clashing(spark, TEXTS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    once = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    both = quality.score_documents(docs.unionByName(docs), labels).collect()
    assert len(both) == 2 * len(once) and all(0 <= r.score <= 1 for r in both)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in both)
    assert once[0].score == once[1].score or once[0].doc_id != once[1].doc_id
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_scores_match_a_plain_discriminant(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice(["the", "of", "Word", "x9", "!!", "a.b"], draw.integers(3, 60))) + "!" * int(draw.integers(0, 9) * (i % 2)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    stats = np.array([quality.statistics(t) for t in texts])
    learns = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(120)])
    marks = np.array([1 - i % 2 for i in range(120)])
    groups = {m: stats[learns & (marks == m)] for m in (0, 1)}
    n = sum(map(len, groups.values()))
    scatter = {m: (g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for m, g in groups.items()}
    pooled = (scatter[0] + scatter[1]) / (n - 2)
    logs = []
    for m, g in groups.items():
        own = (1 - quality.TOWARDS_POOLED) * scatter[m] / (len(g) - 1) + quality.TOWARDS_POOLED * pooled
        own = (1 - quality.TOWARDS_DIAGONAL) * own + quality.TOWARDS_DIAGONAL * np.diag(np.diag(own)) + quality.LEAST_VARIANCE * np.eye(len(own))
        gap = stats - g.mean(axis=0)
        logs.append(np.log(len(g) / n) - 0.5 * (gap * np.linalg.solve(own, gap.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(own)[1])
    plain = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality.TEMPERATURE, -500, 500)))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert np.allclose([got[i] for i in range(120)], plain, atol=1e-9)


def test_equal_identifiers_and_ties(spark):
    ids = [5, 5, 3, 3, 9, 7]
    groups = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(clashing(spark, TEXTS, ids)).collect()}
    by_id = {k[0]: r for k, r in groups.items()}
    assert by_id[5].group_size == 2 and by_id[5].kept  # one text under one identifier
    assert by_id[3].group_size == 2 and by_id[9].keep_id == 7 and not by_id[9].kept  # null equals empty; the smaller one stays
    near = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(clashing(spark, TEXTS, ids)).collect()]
    assert sorted(near) == [(3, 3, True), (3, 3, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 7, False)]
    docs = clashing(spark, ["a line that repeats", "a line that repeats\nown line of it", "own line of it"], [4, 2, 4])
    kept = line_dedup.LineIndex.build(docs).kept(docs)
    assert sum(r.n_dropped for r in kept.collect()) >= 2


def test_search_with_shared_identifiers(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [0.25, 0.0]), (2, [0.25, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", "x", 1) for i, v in rows], "vec_id long, embedding array<float>, query_id string, rank string, score int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_search.top_k(frame.where("vec_id > 0 or embedding[0] = 1"), lambda i: i == 0, 3, 4).collect())
    assert found == [(0, 1, 1, 16), (0, 2, 2, 4), (0, 3, 2, 4)]
    own = exact_search.top_k(frame, lambda i: i == 0, 9, 4).collect()
    assert all(r.vec_id != 0 for r in own)  # rows with the query's identifier are its own


def test_stages_of_the_pipeline_take_odd_documents(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, long_text, "en", None, None), (4, long_text + " end", None, "s", 7),
        (None, "no identifier token = abcdef12", "en", "s", 3), (6, " \n\t ", "en", "s", 4), (7, "é" * 3000, "fr", "s", 5),
    ]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).collect()
        if name != "pack_sequences":
            assert stage(spark, docs, folder).columns == docs.columns
        assert len(out) >= (0 if name == "quality_classifier" else 3)
    near = {r.doc_id for r in dict(corpus_pipeline.STAGES)["drop_near_copies"](spark, docs, folder).collect()}
    assert near == {1, 2, 3, None, 6, 7}
    masked = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["mask_secrets"](spark, docs, folder).collect()}
    assert masked[None] == "no identifier [SECRET]" and masked[1] is None and masked[3] == long_text
