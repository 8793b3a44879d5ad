"""Operators 7, 8 and 9 and the pipeline: bounds, held-out accuracy, brute force."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegate.llm import binpack, exact_search, packing, pieces, quality, secrets

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, texts):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, offset string")


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_bins_stay_between_bound_and_plain_best_fit():
    draw = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(draw.integers(5, 60))
        lengths = draw.integers(1, capacity + 1, draw.integers(1, 40))
        bins, offsets = binpack.best_fit_decreasing(lengths, capacity)
        rooms: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            fitting = [i for i, room in enumerate(rooms) if room >= length]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
        assert bins.max() + 1 == len(rooms)
        assert -(-lengths.sum() // capacity) <= binpack.bins_needed(lengths, capacity) <= len(rooms)


def test_bound_sees_what_the_sum_does_not():
    assert binpack.bins_needed(np.array([6, 6, 6]), 10) == 3
    assert binpack.bins_needed(np.array([4, 4, 4, 4, 4]), 11) == 3
    assert binpack.bins_needed(np.array([], dtype=int), 10) == 0


def test_pieces_and_places(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 300)
    draw = random.Random(2)
    texts = [None, "", "tail \n", " lead", "double  space", "<|endoftext|>", "x" * 9000] + [
        " ".join(f"w{draw.randrange(999)}" for _ in range(draw.randint(1, 1500))) for _ in range(150)
    ]
    rows = packing.pack_documents(documents(spark, texts), TOKENIZER, 512).collect()
    tokenizer = pieces.tokenizer(TOKENIZER)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 512 for r in mine[1:]) and (len(ids) > 512) == (len(mine) > 1)
        for r in mine:
            part = np.asarray(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part)
    used = check_sequences(rows, 512)
    needed = binpack.bins_needed(np.array([r.length for r in rows]), 512)
    assert needed <= used <= needed * 1.015
    assert packing.pack_documents(documents(spark, []), TOKENIZER, 512).count() == 0


def test_statistics_of_odd_texts():
    for text in (None, "", " \n\t", "x", "ſ é" * 3, "a" * 10**6, "| " * 10**5):
        assert np.isfinite(quality.statistics(text)).all()


def test_model_without_labels_is_constant(spark):
    docs = documents(spark, ["a b", "c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(3)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in quality.score_documents(docs, ones).collect()} == {(1.0, 1)}
    assert quality.keep_good(documents(spark, []), ones).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not mounted")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([g > b for g in good for b in bad])
    assert right >= 0.97 and auc >= 0.98, (right, auc)


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(exact_search, "QUERY_BLOCK", 4)
    draw = np.random.default_rng(1)
    points = draw.normal(0, 0.2, (300, 6)).astype("float32")
    points[50:90] = points[7]  # many equal vectors: ties
    rows = [(int(i), v.tolist(), "clash") for i, v in enumerate(points)]
    rows += [(900, None, ""), (1000, [0.1, None], ""), (1100, [float("nan")] * 6, ""), (1200, [float("inf")] * 6, ""), (1300, [], ""), (1400, [0.5, 0.5], ""), (None, [0.1] * 6, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = exact_search.top_k(frame, lambda i: i % 10 == 0, 5, 1024).collect()
    whole = np.floor(1024 * points.astype("float64")).astype("int64")
    expected = set()
    for q in range(0, 300, 10):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(300), -scores)) if i != q][:5]
        expected |= {(q, rank, int(i), int(scores[i])) for rank, i in enumerate(order, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == expected
    assert exact_search.top_k(frame.limit(0), lambda i: i % 10 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not mounted")
def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline
    from tests.llm.test_dedup_operators import SPACE, plain_components
    from tidegate.session import cut_lineage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        results[name] = {r.doc_id: r for r in docs.collect()} if docs.columns == columns else docs.collect()
    start = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    good = results["quality_classifier"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = quality.score_documents(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    assert set(good) == {r.doc_id for r in scores.where("predicted = 1").collect()} and all(good[i] == start[i] for i in good)
    first = {}
    for i in sorted(good):
        first.setdefault(SPACE.sub(" ", good[i].text or ""), i)
    unique = results["drop_exact_copies"]
    assert set(unique) == set(first.values())
    order = sorted(unique)
    components = plain_components([unique[i].text for i in order], percent=80)
    near = results["drop_near_copies"]
    assert set(near) == {order[k] for k, v in components.items() if v[2]}
    masked = results["mask_secrets"]
    assert set(masked) == set(near)
    for i, r in masked.items():
        assert r.text == secrets.masked(near[i].text, secrets.find_spans(near[i].text), "[SECRET]") and r.n_chars == len(r.text)
    packed = results["pack_sequences"]
    assert {r.doc_id for r in packed} == set(masked)
    check_sequences(packed, 2048)
    again = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
