"""Sums over near rows against all pairs, at every depth of the cells, and convergence of windows against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import neighbourhood as N
from lattica.operators import temporal as T


def plain(rows, widths):
    out = []
    for r in rows:
        k, *p = r[:-1]
        if any(x is None for x in r[:-1]):
            out.append((0, None, None))
            continue
        near = [q[-1] for q in rows if q[0] == k and all(x is not None for x in q[:-1]) and all(abs(a - b) <= w for a, b, w in zip(p, q[1:-1], widths, strict=True)) and q[-1] is not None]
        out.append((len(near), float(np.mean(near)) if near else None, float(np.std(near, ddof=1)) if len(near) > 1 else None))
    return out


def same(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0]
        for a, b in zip(g[1:], w[1:], strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, abs(b)))


@pytest.mark.parametrize("limit", [1, 30, 10**6])
def test_two_axes(spark, limit):
    """Points in a heap, on a line, far out, at exactly the half width, repeated many times, with nulls; values far from 0."""
    rng = np.random.default_rng(9)
    rows = [("a", float(x), float(y), 1e6 + float(v)) for x, y, v in rng.normal(size=(120, 3))]
    rows += [("a", k * 0.25, 0.0, 1e6 + float(k)) for k in range(-8, 9)] + [("b", 1.0, 1.0, 2.0)] * 40 + [("b", 1.5, 1.0, 7.0), ("b", -1e9, 3.0, 1.0), ("b", 1.0, 2.0, None)]
    rows += [("b", None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "id long, k string, x double, y double, v double, n string")
    got = N.near_moments(df, ["k"], {"x": 0.5, "y": 1.0}, "v", limit=limit).orderBy("id").collect()
    assert {r.n for r in got} == {"kept"}
    same([(r.n_near, r.mean_near, r.sd_near) for r in got], plain(rows, (0.5, 1.0)))


def test_one_axis_without_keys_and_empty(spark):
    rng = np.random.default_rng(10)
    rows = [(0, float(x), float(v)) for x, v in rng.normal(size=(300, 2))]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "id long, x double, v double")
    got = N.near_moments(df, [], {"x": 0.3}, "v", limit=20).orderBy("id").collect()
    same([(r.n_near, r.mean_near, r.sd_near) for r in got], plain(rows, (0.3,)))
    assert N.near_moments(df.limit(0), [], {"x": 0.3}, "v").count() == 0


def test_full_cells_do_not_meet_whole(spark):
    """10,000 rows within one half width: their sums come from cells, not from a hundred million pairs."""
    df = spark.range(10_000).select("id", (F.col("id") / 20_000).alias("x"), F.col("id").cast("double").alias("v"))
    got = N.near_moments(df, [], {"x": 1.0}, "v", limit=1000)
    r = got.agg(F.min("n_near"), F.max("n_near"), F.max(F.abs(F.col("mean_near") - 4999.5))).first()
    assert (r[0], r[1]) == (10_000, 10_000) and r[2] < 1e-6


def test_convergence(spark):
    rng = np.random.default_rng(11)
    n, x = 13, {(s, k): rng.normal(size=13) for s in ("a", "b") for k in range(4)}
    rows = [(s, k, t, None if (s, k, t) == ("b", 0, 3) else float(v[t])) for (s, k), v in x.items() for t in range(n)]
    x["b", 0][3] = 0.0
    got = {(r.subject, r.length): r for r in T.convergence(spark.createDataFrame(rows, "subject string, node long, step long, value double"), n).collect()}
    assert len(got) == 2 * n
    for s in "ab":
        for length in range(1, n + 1):
            e = [np.sqrt(np.mean([(np.take(x[s, k], range(a, a + length), mode="wrap").mean() - x[s, k].mean()) ** 2 for k in range(4)])) for a in range(n)]
            r = got[s, length]
            assert np.allclose([r.mean, r.sd, r.least, r.greatest], [np.mean(e), np.std(e, ddof=1), min(e), max(e)], atol=1e-9)
