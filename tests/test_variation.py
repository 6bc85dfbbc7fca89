"""Operators on variation, by hand."""

from __future__ import annotations

import numpy as np
import pytest

from lattica.operators import variation as V

GRID = [1.5 + 0.1 * k for k in range(20)]


def test_gaps_are_marked(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 2, None)], "subject string, run long, total long")
    got = sorted((x.run, x.total, x.missing) for x in V.with_gaps(rows, ["subject"], "run", 0, 2).collect())
    assert got == [(0, 5, False), (1, None, True), (2, None, False)]


def test_whole_length_windows_agree_with_the_series(spark):
    rows = [("a", n, t, 1 if (t * (n + 1)) % 3 else -1) for n in range(2) for t in range(6)]
    got = {x.length: x for x in V.wrapped_windows(spark.createDataFrame(rows, "subject string, node long, step long, state int"), [1, 6], 6).collect()}
    assert got[6].greatest == pytest.approx(0) and got[1].greatest > 0
    one = np.array([[s for _, n, _, s in rows if n == m] for m in range(2)], float)
    want = np.sqrt(((one - one.mean(axis=1, keepdims=True)) ** 2).mean(axis=0))
    assert got[1].mean == pytest.approx(want.mean()) and got[1].sd == pytest.approx(want.std(ddof=1))


def test_bootstrap_tells_a_power_law_from_another(spark):
    fits = spark.createDataFrame([("law", 5000, 2.5, 0.004), ("other", 5000, 2.5, 0.2), ("none", 0, None, None)], "k string, n long, exponent double, ks double")
    got = {x.k: x.p for x in V.power_law_bootstrap(fits, ["k"], "n", 1, 100, GRID, 40).collect()}
    assert got["law"] > 0.1 and got["other"] == 0 and "none" not in got
    assert got == {x.k: x.p for x in V.power_law_bootstrap(fits, ["k"], "n", 1, 100, GRID, 40).collect()}
