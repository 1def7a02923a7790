"""Whitening against plain arithmetic in fractions and numpy."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sojourn.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, x binary, n string, component int, `a.b` string"


def brute(rows, components=16):
    """{vec_id: [(n, deviation, {component: (whitened, explained)})]} by length; covariances in exact fractions."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in usable]
    found = []
    for dim in {len(x) for _, x in whole}:
        fit = sorted({x for _, x in whole if len(x) == dim})
        n = len(fit)
        mean = [Fraction(sum(x[d] for x in fit), n) for d in range(dim)]
        centred = [[x[d] - mean[d] for d in range(dim)] for x in fit]
        v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dim)] for i in range(dim)]).reshape(dim, dim)
        e, axes = np.linalg.eigh(v) if dim else (np.zeros(0), v)
        order = [k for k in np.argsort(-e)[:components] if e[k] > 1e-12 * e.max()]
        for i, x in whole:
            if len(x) == dim:
                c = np.array([float(x[d] - mean[d]) for d in range(dim)])
                deviation = sum((n * x[d] - int(n * mean[d])) ** 2 for d in range(dim))
                for rank, k in enumerate(order, 1):
                    found.append((i, rank, n, deviation, c @ axes[:, k] / math.sqrt(e[k]), e[k] / np.trace(v)))
    return found


def check(spark, df, rows, components=16):
    got = [tuple(r) for r in whitening.whiten(df, components).collect()]
    want = brute(rows, components)

    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[2], abs(r[4]))

    assert len(got) == len(want)
    signs = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == (*w[:3], w[3] if w[3] < 2**63 else None)
        assert abs(abs(g[4]) - abs(w[4])) < 1e-8 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-9 and g[6] < 1e-8
        if abs(w[4]) > 1e-6:
            signs.setdefault(g[1:3], set()).add(g[4] * w[4] > 0)
    return got, signs


def test_random_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(150)] + [(3, None)]
    rows += [(7, rows[7][1]), (900, rows[0][1])]
    _, signs = check(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5), rows)
    assert all(len(s) == 1 for s in signs.values())  # one sign per component for all rows


def test_awkward_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [
        (None, rng.normal(size=4).tolist()), (1, rows[1][1]), (1, rows[1][1]), (40, None), (41, []), (42, [1.0, None, 2.0, 3.0]), (43, [math.nan] * 4),
        (44, [1.0, math.inf, 0.0, 0.0]), (45, [0.0] * 4), (46, [1.0, 2.0]), (47, [1.0, 2.5]), (48, [5.0, 5.0, 5.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, b"x", "n", 2, "dot") for i, v in rows], SCHEMA)
    got, _ = check(spark, df, rows)
    # Two vectors of length 2 span one direction; the only one of length 3 has no variance and gives no row.
    assert {r[1] for r in got if r[0] in (46, 47)} == {1} and not [r for r in got if r[0] == 48]
    assert not [r for r in got if r[0] in (40, 41, 42, 43, 44)] and [r for r in got if r[0] is None and r[1] == 4]


def test_great_entries(spark):
    """Beyond 64 bits when squared, and beyond 64 bits themselves: no crash, exact sums."""
    rows = [(i, [1e9 * i, float(i % 3), -2e12 * (i % 5)]) for i in range(20)]
    check(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), rows, 2)
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    found = whitening.whiten(far).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(r.deviation is None for r in found if r.vec_id < 3)


def test_exact_beside_a_large_mean():
    """The mean is a million and the spread below one: nothing cancels."""
    squares = {(0, 0): 4 * 3, (0, 1): 3 + 2 * 1 + 2, (1, 1): 4 * 2}
    v = whitening.covariance(10**12, [3, 2], squares)
    assert v[0, 0] == float(Fraction(3 * 10**12 - 9, 10**24)) and v[0, 1] == v[1, 0] == float(Fraction(10**12 - 6, 10**24))


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    vectors = queries.table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    fit = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows}))
    centred = fit - fit.mean(0)
    e, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {len(fit)}
    sums = fit.sum(0)
    for row in got:
        x = np.array([math.floor(64 * c) + 1_000_000 for c in dict(rows)[row.vec_id]])
        assert row.deviation == int(((len(fit) * x - sums) ** 2).sum())
        assert abs(abs(row.whitened) - abs((x - fit.mean(0)) @ axes[:, -row.component]) / math.sqrt(e[-row.component])) < 1e-7
        assert abs(row.explained - e[-row.component] / e.sum()) < 1e-9 and row.identity_error < 1e-9
