"""Operators 12 and 13 against dense eigenvectors and plain loops."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidegate.llm import vector_codes, whitening

DDL = "vec_id long, embedding array<float>, label int, component string, error string, x string"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, lab, "clash", "clash", "clash") for i, v, lab in rows], DDL)


ODD = [(900, None, 1), (901, [0.1, None, 0.2], 1), (902, [float("nan"), 0.0, 0.0], 1), (903, [float("inf"), 0.0, 0.0], 1), (904, [float("-inf")] * 3, 1)]


def test_transform_is_orthogonal_and_ordered():
    for length in (1, 2, 8, 32):
        rows = vector_codes.transform(np.eye(length, dtype=np.int64)).T
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(length))
        assert (rows @ rows.T == length * np.eye(length)).all()


@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize(("width", "spread"), [(16, 100), (5, 2), (1, 1), (33, 10_000)])
def test_nearest_entry_with_ties(kind, width, spread):
    draw = np.random.default_rng(width)
    x = draw.integers(-spread, spread + 1, (300, width))
    book = x[:40].copy()
    book[17] = book[3]  # a tie goes to the lower index
    gaps = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    entry, least, share = vector_codes.nearest(x.astype(kind), book.astype(kind))
    assert (entry == gaps.argmin(axis=1)).all() and (least == gaps.min(axis=1)).all()
    assert 17 not in entry


def test_clustered_entries_leave_the_race_early():
    draw = np.random.default_rng(0)
    book = np.repeat(draw.integers(-500, 500, (256, 1)), 16, axis=1)
    x = book[draw.integers(0, 256, 500)] + draw.integers(-2, 3, (500, 16))
    assert vector_codes.nearest(x, book)[2] < 0.5


def plain_codes(rows, parts, entries, rounds):
    """Lists and integers only."""
    width = max((len(v) for _, v, _ in rows), default=0)
    size = -(-width // parts)
    whole = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] + [0] * (parts * size - len(v)) for _, v, _ in rows]
    cut = [[w[p * size : (p + 1) * size] for p in range(parts)] for w in whole]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, whole[r]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def find(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[find(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, chosen) if k[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    final = [[find(c[p], p) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    by_label: dict = {}
    for (_, _, lab), e in zip(rows, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        (str(i), str([k for _, k in f]), e, by_label[lab], digest) for (i, _, lab), f, e in zip(rows, final, errors)
    )


@pytest.mark.parametrize("case", ["plain", "few", "unlike lengths", "huge"])
def test_codes_match_plain_loops(spark, case):
    draw = np.random.default_rng(5)
    n, width, size = {"plain": (120, 12, 1.0), "few": (6, 8, 0.01), "unlike lengths": (40, 7, 1.0), "huge": (30, 4, 3e9)}[case]
    rows = [(int(i), [float(c) for c in v], [0, 0, 0, 1, None][i % 5]) for i, v in enumerate(draw.normal(0, size, (n, width)).astype("float32"))]
    rows += [(3, rows[3][1], 0), (None, rows[4][1], None), (50, rows[5][1], 2), (51, rows[5][1], 2)]  # repeated rows, no identifier, ties
    if case == "unlike lengths":
        rows += [(60, [], 1), (61, [0.5], 1)]
    found = vector_codes.compress(embeddings(spark, [*rows, *ODD]), parts=4, entries=16, rounds=3).collect()
    mine = sorted((str(r.vec_id), str(r.codes), int(r.error), int(r.label_error), r.codebooks_sha256) for r in found)
    assert mine == plain_codes(rows, 4, 16, 3)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compress(embeddings(spark, ODD)).count() == 0
    assert vector_codes.compress(embeddings(spark, [])).count() == 0
    rows = vector_codes.compress(embeddings(spark, [(1, [], 1), (2, [], None)])).collect()
    assert {(r.vec_id, tuple(r.codes), int(r.error)) for r in rows} == {(1, (0,) * 4, 0), (2, (0,) * 4, 0)}


def test_solver_without_a_matrix():
    draw = np.random.default_rng(2)
    for width in (1, 3, 12, 90, 250):
        root = draw.normal(size=(width, width))
        dense = root @ root.T
        values, vectors = whitening.jacobi_davidson(lambda v: dense @ v, width, 4)  # noqa: B023
        expected, axes = np.linalg.eigh(dense)
        assert np.allclose(values, expected[::-1][:4], rtol=1e-12)
        for k in range(len(values)):
            assert abs(abs(vectors[:, k] @ axes[:, -1 - k]) - 1) < 1e-12


def test_minres_solves_in_step():
    draw = np.random.default_rng(4)
    systems = [m + m.T for m in draw.normal(size=(3, 9, 9))]
    right = draw.normal(size=(9, 3))
    right[:, 2] = 0
    apply = lambda v: np.column_stack([a @ v[:, i] for i, a in enumerate(systems)])
    found = whitening.minres(apply, right, 9)
    assert np.allclose(apply(found), right, atol=1e-8)


def plain_whitening(rows, pairs):
    width = max(len(v) for _, v in rows)
    x = np.array([[np.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v in rows])
    fit = np.unique(x, axis=0)
    centre = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centre.T @ centre / len(fit))
    values, axes = values[::-1][:pairs], axes[:, ::-1][:, :pairs]
    whole = [[int(c) for c in row] for row in x]
    sums = [int(c) for c in fit.sum(axis=0)]
    deviations = [sum((len(fit) * c - s) ** 2 for c, s in zip(row, sums)) for row in whole]
    return len(fit), deviations, (x - fit.mean(axis=0)) @ axes / np.sqrt(values), values / (centre**2).sum() * len(fit)


@pytest.mark.parametrize("size", [1.0, 4e12])
def test_whitening_matches_dense_eigenvectors(spark, size):
    draw = np.random.default_rng(6)
    points = (draw.normal(0, 0.3, (200, 10)) * np.linspace(1, 3, 10) * size).astype("float32")
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(points)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (250, rows[5][1]), (251, [0.25 * size])]
    n, deviations, z, explained = plain_whitening(rows, 4)
    got = whitening.whiten(embeddings(spark, [*[(i, v, 0) for i, v in rows], *ODD])).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    for k in range(4):
        mine = sorted((str(r.vec_id), int(r.deviation), r.whitened) for r in got if r.component == k + 1)
        sign = max((1, -1), key=lambda s: -abs(sorted(s * z[:, k])[0] - sorted(m[2] for m in mine)[0]))
        plain = sorted((str(i), d, sign * w) for (i, _), d, w in zip(rows, deviations, z[:, k]))
        assert [m[:2] for m in mine] == [p[:2] for p in plain]
        assert np.allclose([m[2] for m in mine], [p[2] for p in plain], atol=1e-9)
        assert np.allclose([r.explained for r in got if r.component == k + 1], explained[k], rtol=1e-9)
    assert {r.identity_error < 1e-10 for r in got} == {True}


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, ODD)).count() == 0
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [], 0)])).count() == 0
    alone = whitening.whiten(embeddings(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert {(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in alone} == {
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)
    }
    line = whitening.whiten(embeddings(spark, [(i, [i / 256, i / 128, 0.0], 0) for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1}
    assert all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)
    assert max(r.identity_error for r in line) < 1e-12
