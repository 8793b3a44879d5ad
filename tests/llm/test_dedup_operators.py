"""Operators 3, 4, 5 and 6 against plain versions on small inputs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegate.llm import bitmaps, components, minhash, passages, quotes
from tidegate.llm.chaining import align, alike_parts, chains
from tidegate.llm.line_dedup import LineIndex

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents(spark, texts, first=0):
    rows = [(first + i, t, "clash", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, n_lines int, id string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- lines ------------------------------------------------------------------------------------


def plain_lines(texts):
    keys = [[lower(line.strip(" \t\n\x0b\x0c\r")) for line in (t or "").split("\n")] for t in texts]
    first = {}
    for i in reversed(range(len(texts))):
        for key in keys[i]:
            first[key] = i
    holders = {key: sum(key in k for k in keys) for key in first}
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        stay = [line for line, k in zip(lines, keys[i]) if len(k) < 10 or holders[k] < 2 or first[k] == i]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def line_texts(seed, n):
    draw = random.Random(seed)
    pool = ["short", "a line of text", "A LINE of text ", "\tanother long line\r", "éééééééééé", "ééééééééé", "", "hot common line", "x" * 50000]
    return [None, ""] + ["\n".join(draw.choices([*pool, f"own line {i}"], k=draw.randint(0, 9))) for i in range(n)]


def rows_of(frame):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in frame.collect()}


def test_lines_match_plain_and_deletions_give_lines_back(spark):
    texts = line_texts(1, 60)
    docs = documents(spark, texts)
    index = LineIndex.build(docs)
    assert rows_of(index.kept(docs)) == dict(enumerate(plain_lines(texts)))
    some = docs.where("doc_id % 3 = 0")
    fewer = index.delete(some.select("doc_id"))
    left = [t for i, t in enumerate(texts) if i % 3]
    expected = {i: v for i, v in zip([i for i in range(len(texts)) if i % 3], plain_lines(left))}
    assert rows_of(fewer.kept(docs.where("doc_id % 3 <> 0"))) == expected
    again = fewer.insert(some)
    assert rows_of(again.kept(docs)) == dict(enumerate(plain_lines(texts)))
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    # the filters exclude no line that is held, and nearly all that are not
    assert again.seen(index.counts.select("h1", "h2")).where("not maybe").count() == 0
    assert index.delete(docs.select("doc_id")).seen(index.counts.select("h1", "h2")).where("maybe").count() == 0


def test_lines_of_an_empty_table(spark):
    docs = documents(spark, [])
    assert LineIndex.build(docs).kept(docs).count() == 0


# -- near copies ------------------------------------------------------------------------------


def plain_components(texts, percent=85):
    sets = []
    for t in texts:
        w = [x for x in SPACE.split(lower(t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(least[i], least[j])
            changed |= least[i] != m or least[j] != m
            least[i] = least[j] = m
    return {i: (len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, least))}


def family(seed, n, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"e{k}x{draw.randrange(99)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_match_plain(spark, seed):
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", *family(seed, 60, 8), *family(seed + 9, 25, 3), "long " + "z y x w v u " * 20000]
    random.Random(seed).shuffle(texts)
    out = minhash.near_duplicates(documents(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == plain_components(texts)
    kept = minhash.drop_near_copies(documents(spark, texts))
    assert kept.columns == ["doc_id", "text", "bucket", "n_lines", "id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in plain_components(texts).items() if v[2])


def test_members_around_the_least_similarity_do_not_meet_all_others(spark, monkeypatch):
    texts = family(4, 240, 6)
    draw, counts, whole = random.Random(4), [], minhash.remaining_pairs
    for k in range(60):  # copies of copies share edits beside the base
        words = texts[draw.randrange(240)].split(" ")
        words[draw.randrange(len(words))] = f"f{k}"
        texts.append(" ".join(words))

    def counted(*args):
        pairs = whole(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "remaining_pairs", counted)
    out = minhash.near_duplicates(documents(spark, texts), percent=80)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == plain_components(texts, 80)
    assert counts[0] <= 3 * len(texts)


def test_joins_with_buckets_and_pairs_take_rows_that_are_met(spark, monkeypatch):
    draw, whole, seen = random.Random(6), bitmaps.narrowed, {}
    alone = [" ".join(f"a{draw.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    texts = [*family(3, 12, 2), *alone]

    def counted(rows, key, wanted):
        out = whole(rows, key, wanted)
        seen.setdefault((key, *rows.columns), []).append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(bitmaps, "narrowed", counted)
    out = minhash.near_duplicates(documents(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == plain_components(texts)
    buckets, signed = seen["bucket", "id", "n_shingles", "bucket"], seen["id", "id", "signature"]
    assert len(buckets) == 1 and len(signed) >= 2  # both ends of the pairs
    assert all(passed <= rows // 10 for rows, passed in [*buckets, *signed])


def test_identifiers_may_be_narrow_integers(spark):
    texts = [*family(5, 30, 6), None, "one two"]
    docs = documents(spark, texts).withColumn("doc_id", F.col("doc_id").cast("int"))
    out = minhash.near_duplicates(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == plain_components(texts)


def test_the_least_similarity_is_a_parameter(spark):
    assert (minhash.band_rows(85), minhash.most_different(85)) == (5, 55)
    words = [f"w{i}" for i in range(300)]
    edited = ["edit" if i in range(20, 300, 48) else w for i, w in enumerate(words)]  # 6 words: 266 of 326 shingles
    far = ["edit" if i in range(20, 300, 40) else w for i, w in enumerate(words)]  # 7 words: 261 of 331
    docs = documents(spark, [" ".join(w) for w in (words, edited, far)])
    assert [r.doc_id for r in minhash.drop_near_copies(docs, percent=85).orderBy("doc_id").collect()] == [0, 1, 2]
    assert sorted(r.doc_id for r in minhash.drop_near_copies(docs, percent=80).collect()) == [0, 2]


def test_near_copies_of_empty_table_and_null_ids(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(rows).collect()) == [(-1, -1, True), (1, 1, True), (2, 1, False)]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + draw.randint(1, 50)) for _ in range(60)] + [(7, 7)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(c == 100 for n, c in found.items() if n > 90)


# -- passages ---------------------------------------------------------------------------------


def test_chains_are_best_under_gap_costs():
    draw = random.Random(2)
    for _ in range(200):
        n = draw.randint(1, 9)
        points = {(draw.randrange(30), draw.randrange(30)) for _ in range(n)}
        a, b = (np.array(c) for c in zip(*sorted(points)))
        best = {}
        for i in sorted(range(len(a)), key=lambda i: (a[i], b[i])):
            before = [best[j] - 0.1 * ((a[i] - a[j]) + (b[i] - b[j])) for j in best if a[j] < a[i] and b[j] < b[i]]
            best[i] = 5.0 + max([0.0, *before])
        path = chains(a, b)[0]
        assert (np.diff(a[path]) > 0).all() and (np.diff(b[path]) > 0).all()
        score = 5.0 * len(path) - 0.1 * ((a[path][-1] - a[path][0]) + (b[path][-1] - b[path][0]))
        assert abs(score - max(best.values())) < 1e-9


def test_alignment_follows_an_insertion():
    left = np.arange(100)
    right = np.r_[500:520, 0:40, 900:903, 40:100]
    start, end, other, other_end, hits = align(left, right, np.array([5, 60]), np.array([25, 83]), 5)
    assert (start, end, other, other_end, hits) == (0, 100, 20, 123, 100)


def test_fuzzy_passages_are_found(spark):
    draw = random.Random(8)
    words = lambda n, tag: [f"{tag}{draw.randrange(10**6)}" for _ in range(n)]
    passage = words(90, "p")
    fuzzy = [w if draw.random() > 0.06 else "changed" for w in passage]
    short = words(40, "s")
    texts = [" ".join(words(300, "a") + passage + words(50, "b")), " ".join(words(20, "c") + fuzzy + words(400, "d")),
             " ".join(words(100, "e") + short), " ".join(short + words(100, "f")), None, "", " ".join(passage).upper(), "w " * 30000]
    rows = {(r.doc_id, r.first_doc_id): r for r in passages.repeated_passages(documents(spark, texts)).collect()}
    assert set(rows) == {(1, 0), (6, 0)}
    assert (rows[6, 0].start_word, rows[6, 0].end_word, rows[6, 0].first_start, rows[6, 0].equal_words) == (0, 90, 300, 90)
    assert rows[1, 0].end_word - rows[1, 0].start_word >= 80
    assert passages.repeated_passages(documents(spark, [])).count() == 0


def test_a_chain_is_split_where_it_is_unlike(spark):
    draw = random.Random(21)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    head, foot, long_head, long_foot = words(60), words(60), words(100), words(100)
    texts = [" ".join(head + words(40) + foot), " ".join(head + words(40) + foot),
             " ".join(long_head + words(55) + long_foot), " ".join(long_head + words(55) + long_foot)]
    rows = sorted(map(tuple, passages.repeated_passages(documents(spark, texts)).collect()))
    assert rows == [(1, 0, 60, 0, 0, 60, 60), (1, 100, 160, 0, 100, 160, 60), (3, 0, 100, 2, 0, 100, 100), (3, 155, 255, 2, 155, 255, 100)]


def test_smaller_documents_with_parts_do_not_hide_a_passage(spark):
    draw = random.Random(31)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    texts, pairs = [], []
    for k in range(12):
        passage, cuts = words(60), [(0, 30, 30, 60), (0, 40, 20, 60), (0, 45, 15, 60)][k % 3]
        n = len(texts)
        texts += [" ".join(words(30) + passage[cuts[0] : cuts[1]] + words(30)), " ".join(words(30) + passage[cuts[2] : cuts[3]] + words(30)),
                  " ".join(words(20) + passage + words(20)), " ".join(words(25) + passage + words(20))]
        pairs.append((n + 3, n + 2, 25, 85, 20, 80))
    rows = passages.repeated_passages(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.start_word, r.end_word, r.first_start, r.first_end) for r in rows) == pairs


def test_parts_cover_every_stretch_that_is_alike():
    draw = random.Random(5)
    for _ in range(300):
        gaps, lengths = ([draw.randint(1, n) for _ in range(draw.randint(1, 12))] for n in (30, 60))
        starts = np.cumsum([0, *(x + y for x, y in zip(lengths, gaps))])[:-1][: len(lengths)]
        lengths, others = np.array(lengths[: len(starts)]), starts + 7
        parts = alike_parts(starts, others, lengths, 50, 0.8)
        ends, inside = starts + lengths, set()
        for start, end, other, other_end, hits in parts:
            assert end - start == other_end - other >= 50 and hits >= 0.8 * (end - start)
            inside |= set(range(start, end))
        for i in range(len(starts)):
            for j in range(i, len(starts)):
                size = ends[j] - starts[i]
                if size >= 50 and lengths[i : j + 1].sum() >= 0.8 * size:
                    assert set(range(starts[i], ends[j])) <= inside
        if lengths.sum() >= 0.8 * (ends[-1] - starts[0]) and ends[-1] - starts[0] >= 50:
            assert len(parts) == 1


# -- quotes -----------------------------------------------------------------------------------


def test_quotes_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "user", "Hello there\n\nsecond paragraph"), (1, 1, "assistant", "> hello   THERE\nI agree"),
        (1, 2, "user", "> > Hello there\n> I agree\nthanks"), (1, 3, "user", ">>> unknown\nno link"), (1, 4, "user", "> second paragraph\nyes"),
        (1, 5, "user", None), (2, 0, "user", ""), (None, 0, "user", "> Hello there"), (2, None, "user", "lost"), (1, 5, "user", ">" * 30000 + " deep"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    out = quotes.reply_order(frame)
    got = sorted((r.conv_id or -1, -1 if r.turn is None else r.turn, r.own_text, r.n_passages, r.n_linked, r.parent_turn, r.root_turn, r.depth, r.reply_order) for r in out.where("conv_id = 1 and turn < 5").collect())
    assert got == [
        (1, 0, "Hello there\n\nsecond paragraph", 0, 0, None, 0, 0, 1), (1, 1, "I agree", 1, 1, 0, 0, 1, 2),
        (1, 2, "thanks", 2, 2, 1, 0, 2, 3), (1, 3, "no link", 1, 0, None, 3, 0, 5), (1, 4, "yes", 1, 1, 0, 0, 1, 4),
    ]
    assert out.count() == len(rows) and quotes.reply_order(frame.limit(0)).count() == 0
