"""Whitening against numpy's eigenvectors over whole-number vectors; counts and intervals by themselves."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fleetcases.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, c string"


def _got(spark, vectors, **kw):
    rows = [(i, v, 1, 2, "c") for i, v in vectors]
    return [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw).collect()]


def _x(vectors):
    good = [(i, v) for i, v in vectors if v and all(e is not None and math.isfinite(e) for e in v)]
    return [(i, tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v)) for i, v in good]


def check(rows, vectors, most=16):
    x = _x(vectors)
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    y = np.array([[float(Fraction(v[k] * n - s[k], n)) for k in range(d)] for v in fit])
    v = y.T @ y / n
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(rows) == len(x) * k
    by_component = {c: sorted((r for r in rows if r[1] == c), key=repr) for c in range(1, k + 1)}
    deviation = {vec: sum((n * vec[j] - s[j]) ** 2 for j in range(d)) for _, vec in x}
    assert sorted((r[0], r[3]) for r in by_component[1] if r[0] is not None) == sorted(
        (i, deviation[vec]) for i, vec in x if i is not None)
    assert {r[2] for r in rows} == {n} and len({r[6] for r in rows}) == 1 and rows[0][6] < 1e-9
    for c, part in by_component.items():
        assert part[0][5] == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
    # recovered directions are unit eigenvectors: projections of the fit list have them as least-squares solution
    at = {}
    for i, vec in x:
        at.setdefault(i, vec)
    seen = {}
    for r in rows:
        if r[0] in at and r[0] is not None:
            seen.setdefault((r[0], r[1]), r[4])
    ids = sorted(i for i in at if i is not None)
    z = np.array([[seen[(i, c)] for c in range(1, k + 1)] for i in ids])
    cov = np.zeros((k, k))
    one = {at[i]: row for i, row in zip(ids, z, strict=True)}
    if len(one) == n:
        zs = np.array([one[vec] for vec in fit])
        cov = zs.T @ zs / n
        assert np.abs(cov - np.eye(k)).max() < 1e-9
        w = np.linalg.lstsq(y, zs * np.sqrt(values[:k]), rcond=None)[0]
        if n > d:
            assert np.abs(v @ w - w * values[:k]).max() < 1e-9 * values[0]
            assert np.abs(np.linalg.norm(w, axis=0) - 1).max() < 1e-9


def test_whitening_equals_dense_solution(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24)) * np.linspace(3, 0.4, 24) + 5
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(1000 + i, base[0].tolist()) for i in range(150)]             # a group of copies counts once
    vectors += [(None, base[1].tolist()), (5000, None), (5001, []), (5002, [None] * 24), (5003, [float("nan")] + [0.0] * 23),
                (5004, [float("-inf")] + [0.0] * 23), (5005, [1.0, 2.0])]
    check(_got(spark, vectors), vectors[:-1])


def test_equal_eigenvalues_and_few_components(spark):
    d = 20      # +-1 along every axis: all eigenvalues are equal
    vectors = [(2 * k + (s < 0), [float(s) if j == k else 0.0 for j in range(d)]) for k in range(d) for s in (1, -1)]
    rows = _got(spark, vectors)
    assert len(rows) == 40 * 16 and rows[0][6] < 1e-9
    assert all(r[5] == pytest.approx(1 / d, rel=1e-9) for r in rows)
    assert _got(spark, [(1, [1.0, 2.0])] * 3) == []                       # no variance, no component
    check(_got(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0])]), [(1, [1.0, 2.0]), (2, [3.0, 5.0])])
    check(_got(spark, [(i, [i * 1.5, float(i % 7), float(i % 3)]) for i in range(50)], n_components=2),
          [(i, [i * 1.5, float(i % 7), float(i % 3)]) for i in range(50)], most=2)


def test_empty_and_unusable_tables(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(1, None), (2, [None]), (3, [float("inf")])]) == []


def test_large_entries_stay_exact(spark):
    vectors = [(i, [float(np.float32(10.0 ** (i % 9)) * (-1) ** i), float(i)]) for i in range(40)]
    rows = _got(spark, vectors)
    n, x = 40, _x(vectors)
    s = [sum(v[k] for _, v in x) for k in range(2)]
    want = {i: sum((n * v[k] - s[k]) ** 2 for k in range(2)) for i, v in x}
    assert {r[0]: r[3] for r in rows} == {i: w if w < 2**63 else None for i, w in want.items()}


def test_inertia_counts_and_projections():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    values = np.sort(np.concatenate([[9.0] * 10, [5.0, 5.0 + 1e-9], rng.uniform(0, 4, 18)]))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    diag, off = whitening.tridiagonal(v)
    for s in (-1, 0.5, 2, 4.5, 5.0 + 5e-10, 7, 9.5):
        assert whitening.count_below(diag, off, s) == (values < s).sum()
    got, vectors = whitening.components(v, 16)
    assert np.abs(got - values[::-1][:16]).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12
    pairs = whitening.feast(v, 1.0, 4.0, int(((values >= 1) & (values < 4)).sum()), 1e-13)
    assert pairs.shape[1] == ((values >= 1) & (values < 4)).sum()


@pytest.mark.parametrize("seed", [15, 74, 125])
def test_eigenvalues_close_beside_an_interval(seed):
    rng, d = np.random.default_rng(seed), 64
    g = rng.standard_normal((d, d))
    v = 64 * (np.eye(d) + (g + g.T) / 2 * np.sqrt(2 / 51282))
    for _ in range(seed % 3):
        u = rng.standard_normal(d)
        u /= np.linalg.norm(u)
        v += rng.uniform(20, 80) * np.outer(u, u)
    v = (v + v.T) / 2
    got, vectors = whitening.components(v, 16)
    assert np.abs(got - np.linalg.eigvalsh(v)[::-1][:16]).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert np.abs(v @ vectors - vectors * got).max() < 1e-11


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0, 0, "") for i, v in enumerate(rng.standard_normal((200, 8)))]
    df = spark.createDataFrame(rows, SCHEMA)
    a = sorted(map(tuple, whitening.whiten(df.repartition(7)).collect()))
    assert a == sorted(map(tuple, whitening.whiten(df.coalesce(1)).collect()))
