"""Networks: gradients by differences, fits, early stopping, grids; message passing by matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import networks as N


def test_linear_setting_finds_the_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    rows = [("a", float(p), float(q), float(2 * p - q + 0.5)) for p, q in x]
    grid = spark.createDataFrame([("line", 1, 0, 0.05, 32, False, s) for s in (0, 1)], "setting string, width int, depth int, rate double, batch int, skip boolean, split long")
    curves = N.learning_curves(spark.createDataFrame(rows, "k string, p double, q double, y double"), ["k"], ["p", "q"], "y", grid, epochs=80)
    best = N.best_settings(curves, ["k"]).first()
    assert best.rmse < 0.02 and best.corr > 0.999
    assert sorted(curves.collect()) == sorted(N.learning_curves(spark.createDataFrame(rows[::-1], "k string, p double, q double, y double"), ["k"], ["p", "q"], "y", grid, epochs=80).collect())


def test_deep_and_skipping_networks_bend(spark):
    x = np.random.default_rng(2).uniform(-2, 2, 600)
    rows = [("a", float(v), float(abs(v))) for v in x]
    settings = [("line", 1, 0, False), ("deep", 12, 2, False), ("skip", 12, 3, True)]
    grid = spark.createDataFrame([(n, w, d, 0.02, 32, s, 0) for n, w, d, s in settings], "setting string, width int, depth int, rate double, batch int, skip boolean, split long")
    curves = N.learning_curves(spark.createDataFrame(rows, "k string, p double, y double"), ["k"], ["p"], "y", grid, epochs=150, patience=25)
    error = {r.setting: r.e for r in curves.groupBy("setting").agg(F.min("test_rmse").alias("e")).collect()}
    assert error["line"] > 0.4 and error["deep"] < 0.1 and error["skip"] < 0.1
    assert N.best_settings(curves, ["k"]).first().setting in ("deep", "skip")
    ended = {r.setting: r for r in curves.where("stopped").collect()}
    assert "line" in ended and ended["line"].epoch < 149


def test_messages_by_matrices(spark):
    w = np.array([[0, 1.0, 2.0], [1.0, 0, 0], [2.0, 0, 0]])
    x = np.array([1.0, 2.0, 4.0])
    edges = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 2.0)], "k string, i long, j long, w double")
    nodes = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, node long, f double")
    got = {r.node: (r.pass_0, r.pass_1, r.pass_2) for r in N.convolved(edges, nodes, ["k"], "w", "f", 2).collect()}
    p = w / w.sum(axis=1, keepdims=True)
    assert all(np.allclose(got[i], (x[i], (p @ x)[i], (p @ p @ x)[i])) for i in range(3))
