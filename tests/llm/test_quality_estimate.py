"""The minimum-covariance-determinant estimate of operator 9 against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcases.llm import quality

SCHEMA = "lang string, source string, x0 long, x1 long, x2 long, x3 long, x4 long"


def _frame(spark, groups):
    rows = [(lang, source, *map(int, v)) for (lang, source), x in groups.items() for v in np.round(x * quality.UNIT)]
    return spark.createDataFrame(rows, SCHEMA)


def _group(rng, n, bad, scale=1.0):
    mix = np.tril(rng.normal(size=(5, 5)), -1) * 0.4 + np.eye(5)
    x = 5 + scale * rng.normal(size=(n, 5)) @ mix.T
    x[:bad] = 5 + scale * (12 + rng.normal(size=(bad, 5))) * [1, -1, 1, -1, 1]
    return x


def _brute(x, starts=300, seed=1):
    """Least log determinant over many random starts, and its distances after reweighting."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    h = (len(x) + 1) // 2

    def distances(at, scale):
        m, c = x[at].mean(axis=0), quality.regularised(np.cov(x[at].T, bias=True), len(at), scale)
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m), np.linalg.slogdet(c)[1]
    for _ in range(starts):
        at, last = rng.choice(len(x), 8, replace=False), np.inf
        while True:
            d, _ = distances(at, quality.HALF_SCALE)
            at = np.argsort(d, kind="stable")[:h]
            d, det = distances(at, quality.HALF_SCALE)
            if det >= last - 1e-9:
                break
            last = det
        best = min(best, (last, d), key=lambda b: b[0])
    return best[0], distances(np.flatnonzero(best[1] <= quality.NEAR), quality.NEAR_SCALE)[0]


def test_determinant_and_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    groups = {("en", "a"): _group(rng, 400, 150), ("en", None): _group(rng, 300, 20, 0.3), (None, "a"): _group(rng, 200, 0, 2.0)}
    est = {(r.lang, r.source): r for r in quality.fit(_frame(spark, groups).repartition(5)).collect()}
    assert est.keys() == groups.keys()
    for key, x in groups.items():
        x = np.round(x * quality.UNIT) / quality.UNIT
        d = x - np.array(est[key].m)
        got = np.einsum("ni,ij,nj->n", d, np.array(est[key].w).reshape(5, 5), d)
        _, want = _brute(x)
        assert ((got <= quality.CUTOFF) == (want <= quality.CUTOFF)).all()
        assert np.median(np.abs(got / want - 1)) < 0.1


def test_determinant_falls_below_every_start(spark):
    rng = np.random.default_rng(12)
    x = _group(rng, 300, 110)
    raw = []
    kept = quality.stage

    def watch(df, name):
        out = kept(df, name)
        if name == "quality-estimate":
            raw.append({r.start: r.logdet for r in out.collect()})
        return out
    quality.stage = watch
    try:
        quality.fit(_frame(spark, {("en", "a"): x}))
    finally:
        quality.stage = kept
    for before, after in zip(raw, raw[1:], strict=False):
        assert all(after[k] <= before[k] for k in before)
    assert min(raw[-1].values()) <= _brute(np.round(x * quality.UNIT) / quality.UNIT)[0] + 0.05


def test_spread_and_covariance_decide(spark):
    """Two groups of equal centre: what is far in the narrow one is kept in the wide one, and a vector against the
    correlation of its group is far although each coordinate is ordinary."""
    rng = np.random.default_rng(13)
    narrow, wide = 5 + 0.3 * rng.normal(size=(400, 5)), 5 + 2.0 * rng.normal(size=(400, 5))
    tied = 5 + rng.normal(size=(400, 1)) + 0.05 * rng.normal(size=(400, 5))
    est = {r.source: r for r in quality.fit(_frame(spark, {("en", "n"): narrow, ("en", "w"): wide, ("en", "t"): tied})).collect()}

    def far(source, v):
        d = np.array(v) - np.array(est[source].m)
        return float(d @ np.array(est[source].w).reshape(5, 5) @ d)
    assert far("n", [8, 8, 8, 8, 8]) > quality.CUTOFF > far("w", [8, 8, 8, 8, 8])
    assert far("t", [6, 6, 6, 6, 6]) < quality.CUTOFF < far("t", [6, 4, 6, 4, 6])


def test_verdicts_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.lit("s"))
    one, many = (sorted(map(tuple, quality.score_quality(x).collect()), key=repr) for x in (d.repartition(1), d.repartition(13)))
    assert one == many


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_groups_keep_their_documents(spark, n):
    x = 5 + np.arange(5 * n).reshape(n, 5) / 50
    est = quality.fit(_frame(spark, {("en", "a"): x})).collect()
    assert len(est) == 1 and np.isfinite(est[0].w).all()
