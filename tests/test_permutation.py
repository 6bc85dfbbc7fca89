"""Permutation summaries against plain loops, in one and in many parts, with missing cells."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import inference as I
from lattica.operators import permutation as P

U, C = 12, 3


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 4, U, C))
    y[0] += x[0]
    y[3] = 1.0  # no spread
    return x, y


def frame(spark, x, y):
    rows = [(k, f"s{u:02d}", c, None if np.isnan(x[k, u, c]) else float(x[k, u, c]), None if np.isnan(y[k, u, c]) else float(y[k, u, c])) for k in range(len(x)) for u in range(U) for c in range(C)]
    return spark.createDataFrame(rows, "feature long, subject string, node long, x double, y double")


def plain(x, y, n, shuffle, draw, seed=1):
    names, out = [f"s{u:02d}" for u in range(U)], {}
    moves = P.partners(names, 0, n, draw, seed, "")
    cols = P.partners(list(range(C)), 0, n, draw, seed, "n")
    for k in range(len(x)):
        def corr(y2):
            ok = ~np.isnan(x[k]) & ~np.isnan(y2)
            a, b = x[k][ok], y2[ok]
            return np.corrcoef(a, b)[0, 1] if a.std() > 0 and b.std() > 0 else np.nan

        null = np.array([corr(y[k][m][:, c] if shuffle == "both" else y[k][m]) for m, c in zip(moves, cols, strict=True)])
        out[k] = corr(y[k]), np.abs(null)
    return out


@pytest.mark.parametrize("shuffle", ["units", "both"])
@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("parts", [1, 3])
def test_equals_loops(spark, values, shuffle, missing, parts):
    x, y = (v.copy() for v in values)
    if missing:
        x[1, 2, 1] = y[1, 5, 0] = y[0, 0, 0] = np.nan
    draw = "seeded" if parts == 3 else "digest"
    got = P.permuted_summary(frame(spark, x, y), "subject", ["feature"], "x", "y", 70, 9, column="node", shuffle=shuffle, draw=draw, parts=parts)
    for r in got.collect():
        seen, null = plain(x, y, 70, shuffle, draw)[r.feature]
        if np.isnan(seen):
            assert r.corr is None and r.n_null == 0 and r.top == []
            continue
        assert abs(r.corr - seen) < 1e-12 and r.n_null == 70 and r.n_beyond == (null >= abs(seen)).sum()
        assert np.allclose(r.top, np.sort(null)[::-1][:9])


def test_equals_the_joined_null(spark, values):
    """The summary of what permuted_correlations and against_null make of the same draws."""
    rows = frame(spark, *values).where("feature < 3")
    seen = rows.groupBy("feature", "node").agg(F.corr("x", "y").alias("corr"))
    null = I.permuted_correlations(rows, "subject", "node", ["feature", "node"], "x", "y", 40, "subjects")
    want = {(r.feature, r.node): r for r in I.against_null(seen, null, ["feature", "node"], 0.4, 4, 40).collect()}
    got = P.permuted_summary(rows, "subject", ["feature", "node"], "x", "y", 40, P.critical_place(40, 4, 0.4), draw="digest", tags=("s", ""))
    for r in P.tested(got, 40, 4, 0.4).collect():
        w = want[r.feature, r.node]
        assert np.allclose([r.corr, r.p, r.critical, r.p_corrected], [w.corr, w.p, w.critical, w.p_corrected])


def test_quantile(spark):
    top, column = P.quantile_of_top(0.95, 200)
    v = np.random.default_rng(0).random(200)
    row = spark.createDataFrame([(np.sort(v)[::-1][:top].tolist(),)], "top array<double>").select(column).first()
    assert abs(row[0] - np.quantile(v, 0.95)) < 1e-12


def test_a_hundred_thousand_permutations(spark):
    """64 features of 200 subjects: p of a planted feature is least, those of the others are spread evenly."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(64, 200)), rng.normal(size=200)
    x[5] += 0.5 * y
    rows = spark.createDataFrame([(f, u, float(x[f, u]), float(y[u])) for f in range(64) for u in range(200)], "feature long, subject long, x double, y double")
    began = time.time()
    n = 100_000
    got = {r.feature: r for r in P.tested(P.permuted_summary(rows, "subject", ["feature"], "x", "y", n, P.critical_place(n, 64, 0.05)), n, 64, 0.05).collect()}
    assert time.time() - began < 60
    assert len(got) == 64 and got[5].p < 1e-4 and abs(got[5].corr) > got[5].critical
    assert 0.3 < np.mean([r.p for f, r in got.items() if f != 5]) < 0.7


def test_empty(spark, values):
    rows = frame(spark, *values).limit(0)
    assert P.permuted_summary(rows, "subject", ["feature"], "x", "y", 10, 2).count() == 0


def test_many_units_are_never_in_one_place(spark, monkeypatch):
    """Buckets and blocks of a few units give what all units in one task give, with cells and y missing and cells that stand twice."""
    rng = np.random.default_rng(23)
    rows = [(u, f, None if rng.random() < 0.05 else float(rng.normal()), None if u % 41 == 0 else float(u % 7)) for u in range(300) for f in "abc"]
    rows += [(5, "a", 9.0, 5.0), (None, "a", 1.0, 1.0)] + [(u, "still", 2.0, float(u % 7)) for u in range(1, 9)]
    df = spark.createDataFrame(rows, "unit long, feature string, x double, y double").repartition(5)
    want = {r.feature: r for r in P.permuted_summary(df, "unit", ["feature"], "x", "y", 60, 7, draw="digest").collect()}
    with monkeypatch.context() as m:
        m.setattr(P, "partners", None)  # draws all units at once
        got = {r.feature: r for r in P.many_units_summary(df, "unit", ["feature"], "x", "y", 60, 7, bucket=50, block=32).collect()}
    assert got.keys() == want.keys() == {"a", "b", "c", "still"}
    for k, r in got.items():
        assert (r.n_null, r.n_beyond) == (want[k].n_null, want[k].n_beyond) and np.allclose(r.top, want[k].top, atol=1e-12)
        assert (r.corr is None) == (k == "still") and (r.corr is None or abs(r.corr - want[k].corr) < 1e-12)
    assert P.many_units_summary(df.limit(0), "unit", ["feature"], "x", "y", 10, 2).count() == 0
