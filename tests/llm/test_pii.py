"""Operator 11: patterns against the plain ones, the network against sums over all paths, whole results."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidegate.llm import bilstm, pii

# The patterns as the contract states them.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
PHONE, IP, CARD, MAIL = "+1 (826) 555-4081", "190.137.223.204", "4550997810720808", "ann.b@mail.example.com"


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                twice = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans_match_plain_patterns():
    draw = random.Random(4)
    pieces = [PHONE, IP, CARD, MAIL, "a@b.c@d.e", "@", ".", "-", " ", "+", "1", "999.1.1.1", "0001.02.3.4.5.6.7.8", "é", "١٢", "x", "12 34-56", "\n"]
    for _ in range(3000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 9)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in (None, ""):
        assert pii.base_spans(text) == []


@pytest.mark.parametrize("text", ["a" * 10**6, "1" * 10**6, "1." * 10**6, "+1" + " " * 10**6, "@" * 10**6, "a@" * 10**6, "+1 " * 10**5])
def test_patterns_take_long_runs_in_linear_time(text):
    assert len(pii.base_spans(text)) <= 5 * 10**5


def tiny_tagger(seed):
    draw = np.random.default_rng(seed)
    model = bilstm.Tagger.fresh(3, 3, seed)
    return bilstm.Tagger(*[draw.normal(0, 0.7, w.shape) for w in model.weights()])


def path_score(model, scores, path):
    total = model.start[path[0]] + scores[0, path[0]]
    return total + sum(model.step[a, b] + scores[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))


def test_decoding_and_loss_against_all_paths():
    for seed in range(5):
        model = tiny_tagger(seed)
        ids = np.random.default_rng(seed).integers(0, 130, (3, 5)).astype(np.uint8)
        scores = model.emissions(ids)
        best, _ = model.decode(ids)
        gold = np.random.default_rng(seed + 1).integers(0, 3, (3, 5))
        loss = 0.0
        for b in range(3):
            totals = {p: path_score(model, scores[:, b], p) for p in itertools.product(range(3), repeat=5)}
            assert tuple(best[b]) == max(totals, key=totals.get)
            loss += (np.logaddexp.reduce(list(totals.values())) - totals[tuple(gold[b])]) / 3
        assert np.isclose(model.gradients(ids, gold)[0], loss)


def test_slopes_match_differences():
    model = tiny_tagger(7)
    draw = np.random.default_rng(7)
    ids, gold = draw.integers(0, 6, (4, 7)).astype(np.uint8), draw.integers(0, 3, (4, 7))
    _, slopes = model.gradients(ids, gold)
    for w, g in zip(model.weights(), slopes):
        for _ in range(5):
            at = tuple(int(draw.integers(s)) for s in w.shape)
            at = (at[0], int(draw.integers(6)), at[2]) if w is model.look else at
            old, differences = w[at], []
            for step in (1e-3, -1e-3):
                w[at] = old + step
                differences.append(model.gradients(ids, gold)[0])
            w[at] = old
            assert np.isclose((differences[0] - differences[1]) / 2e-3, g[at], atol=1e-4)


def test_windows_cover_and_overlap():
    for length in (0, 1, 95, 127, 128, 129, 224, 225, 1000):
        found = pii.windows(length)
        assert found[0][0] == 0 and found[-1][1] == length
        assert all(b - a <= pii.WINDOW for a, b in found)
        assert all(y - c >= pii.WINDOW - pii.STRIDE or length <= pii.WINDOW for (_, y), (c, _) in zip(found, found[1:]))


def test_reconciliation():
    # a span of three windows comes out whole
    cut = [(1, 100, 128, 5.0, False, True), (1, 96, 224, 20.0, True, True), (1, 192, 230, 6.0, True, False)]
    assert pii.reconcile(cut) == [(1, 96, 230)]
    # two windows that agree give one span; alternatives are settled by their total
    assert pii.reconcile([(2, 5, 9, 3.0, False, False)] * 2) == [(2, 5, 9)]
    draw = random.Random(3)
    for _ in range(300):
        spans = []
        for _ in range(draw.randint(0, 7)):
            a = draw.randint(0, 15)
            spans.append((draw.randint(1, 3), a, a + draw.randint(1, 6), float(draw.randint(1, 9)), False, False))
        gains = {}
        for tag, a, b, gain, *_ in spans:
            gains[tag, a, b] = max(gain, gains.get((tag, a, b), 0))
        apart = lambda some: all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(some, 2))
        most = max(sum(gains[s] for s in some) for n in range(len(gains) + 1) for some in itertools.combinations(gains, n) if apart(some))
        chosen = pii.reconcile(spans)
        assert apart(chosen) and sum(gains[s] for s in chosen) == most


def corpus(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")


def test_network_finds_what_patterns_swallow(spark):
    draw = random.Random(8)
    words = "the in of and that with for on at by when there other".split()
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    card = lambda: next(c for c in iter(lambda: str(draw.randrange(10**15, 10**16)), None) if pii.luhn(pii.digits_of(c)))
    texts = []
    for _ in range(400):
        phone = f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}"
        ip = ".".join(str(draw.randint(0, 255)) for _ in range(4))
        value = draw.choice([phone, ip, card(), f"{draw.choice(words)}.{draw.randint(10, 99)}@mail{draw.randint(0, 9)}.example.com"])
        texts.append(f"{prose(draw.randint(0, 30))} {value} {prose(draw.randint(0, 30))}")
    joined = [f"{prose(9)} {PHONE} {IP} {prose(9)}", f"{prose(40)} {CARD} {card()} {prose(3)}", f"{prose(300)} {PHONE} {IP} {prose(300)}"]
    clean = [prose(50) for _ in range(100)] + ["in 2021 there were 17 of 300", "a" * 5000, "9" * 5000]
    odd = [None, "", joined[0], texts[0], texts[0]]
    docs = corpus(spark, [*texts, *clean, *joined, *odd])
    rows = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        assert [s[:3] for s in rows[r.doc_id] if s[3]] == pii.base_spans(r.text)
        for kind, a, b, base in rows[r.doc_id]:
            assert base or pii.whole(kind, r.text[a:b])
    first = len(texts)
    assert all(rows[first + i] == [] for i in range(len(clean)))
    for i, text in enumerate(joined):
        wanted = [(kind, text.index(v), text.index(v) + len(v)) for kind, v in (("phone", PHONE), ("ip", IP), ("card", CARD)) if v in text]
        got = [s[:3] for s in rows[first + len(clean) + i]]
        assert sum(w in got for w in wanted) >= len(wanted), (text, got)
    assert rows[first + len(clean) + 3] == rows[first + len(clean) + 4] == []
    assert rows[first + len(clean) + 5] == rows[first + len(clean)]


def test_corpus_without_personal_data(spark):
    assert pii.fit(corpus(spark, ["plain words", None, ""])) is None
    assert {len(r.spans) for r in pii.find(corpus(spark, ["plain words", None, ""])).collect()} == {0}
    assert pii.find(corpus(spark, [])).count() == 0


def test_query_digests(spark):
    from tidegate.llm.queries import op11_personal_data

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op11_personal_data(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = plain_base(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in plain]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in plain) for kind in pii.KINDS]
        assert set(listed) <= set(filter(None, r.spans.split(",")))
