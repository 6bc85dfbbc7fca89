"""Operators on small hand-checked inputs, and kernels against exact results."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import binarize as B
from lattica.operators import models as P
from lattica.operators import moments as M
from lattica.operators import relate as R
from lattica.operators import sampling as K
from lattica.operators import spectra as X
from lattica.operators import statistics as S
from lattica.operators import temporal as T

PANEL = "subject string, node long, step long, value long"


def series(spark, values, node=0):
    return spark.createDataFrame([("a", node, t, v) for t, v in enumerate(values)], PANEL)


def test_median_ties_are_balanced(spark):
    got = B.median_balanced(series(spark, [1, 2, 2, 2, 3, 4])).orderBy("step").collect()
    assert [x.state for x in got] == [-1, -1, -1, 1, 1, 1]


def test_constant_series(spark):
    flat = series(spark, [5, 5, 5])
    assert [x.constant for x in B.constant_series(flat).collect()] == [5]
    assert {x.scaled for x in B.normalized(flat, "z").collect()} == {None}
    assert T.lag_correlation(flat, 1).first().autocorrelation is None


def test_runs_drop_both_ends(spark):
    counts = spark.createDataFrame([("a", t, n) for t, n in enumerate([0, 2, 1, 0, 0, 3, 0, 1])], "subject string, step long, n_active long")
    got = {(x.active, x.begin, x.duration, x["size"]) for x in T.runs(counts).collect()}
    assert got == {(True, 1, 2, 3), (False, 3, 2, 0), (True, 5, 1, 3), (False, 6, 1, 0)}


def test_scaler_round_trip(spark):
    panel = series(spark, [1, 4, 9, 16])
    fit = B.fitted_scaler(panel, B.SERIES)
    z = B.apply_scaler(panel, fit, B.SERIES).select("subject", "node", "step", F.col("scaled").alias("value"))
    back = B.apply_scaler(z, fit, B.SERIES, inverse=True).orderBy("step").collect()
    assert [round(x.scaled, 9) for x in back] == [1, 4, 9, 16]


def test_band_join_is_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "k", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (60, 2)))]
    got = R.in_band(spark.createDataFrame(rows, "id long, key string, x double, y double"), ["key"], {"x": 0.5, "y": 0.7})
    want = {(a[0], b[0]) for a, b in itertools.product(rows, rows) if abs(a[2] - b[2]) <= 0.5 and abs(a[3] - b[3]) <= 0.7}
    assert {(x.id, x.id_other) for x in got.collect()} == want


def test_best_replica_ignores_nan(spark):
    rows = spark.createDataFrame([("t", 0, float("nan")), ("t", 1, 0.5), ("t", 2, 0.5), ("t", 3, None)], "target string, replica long, g double")
    assert R.best(rows, ["target"], "g", [], "replica").first().replica == 1


def test_redundant_forms_agree(spark):
    panel = spark.createDataFrame([("a", n, t, 1 if (n * t) % 3 else -1) for n in range(4) for t in range(20)], "subject string, node long, step long, state int")
    full = M.fisher_information(panel).where("a = b").select("a", "information")
    diagonal = M.fisher_diagonal(panel).select("a", "information")
    assert {tuple(x) for x in full.collect()} == {tuple(x) for x in diagonal.collect()}


@pytest.fixture(scope="module")
def exact4(spark):
    h = [0.3, -0.2, 0.1, 0.0]
    w = {(0, 1): 0.4, (0, 2): -0.3, (0, 3): 0.2, (1, 2): 0.1, (1, 3): -0.2, (2, 3): 0.25}
    fields = spark.createDataFrame([("m", n, x) for n, x in enumerate(h)], "model string, node long, h double")
    couplings = spark.createDataFrame([("m", i, j, x) for (i, j), x in w.items()], "model string, i long, j long, w double")
    return fields, couplings


def test_sampler_meets_exact_probabilities(spark, exact4):
    truth = {(x.i, x.j): x.value for x in P.expected(P.enumerate_states(*exact4, 4), 4).collect()}
    got = {(x.i, x.j): x.value for x in K.simulated_means(K.assemble(*exact4), 20_000).collect()}
    assert max(abs(truth[k] - got[k]) for k in truth) < 0.04


def test_reruns_agree(exact4):
    models = K.assemble(*exact4)
    assert sorted(K.simulated_means(models, 50).drop("flip_rate").collect()) == sorted(K.simulated_means(models, 50).drop("flip_rate").collect())


def test_learning_lowers_the_error(spark, exact4):
    truth = P.expected(P.enumerate_states(*exact4, 4), 4)
    value = {(x.i, x.j): x.value for x in truth.collect()}
    p = [[1.0 if i == j else value[min(i, j), max(i, j)] for j in range(4)] for i in range(4)]
    targets = spark.createDataFrame([("m", [value[i, i] for i in range(4)], sum(p, []))], "model string, m array<double>, p array<double>")
    start = K.assemble(exact4[0].withColumn("h", F.lit(0.0)), exact4[1].withColumn("w", F.lit(0.0)))
    fitted = K.fit_by_simulation(start, targets, 300, 50, 0.05).first()
    assert np.abs(np.array(fitted.h) - [0.3, -0.2, 0.1, 0.0]).max() < 0.2


def test_pseudolikelihood_rests_at_the_truth(spark, exact4):
    """On a panel that holds each state as often as the model says, the gradient is near 0."""
    rows, t = [], 0
    for x in P.enumerate_states(*exact4, 4).collect():
        for _ in range(round(x.p * 2000)):
            rows += [("m", n, t, 1 if x.code >> n & 1 else -1) for n in range(4)]
            t += 1
    panel = spark.createDataFrame(rows, "subject string, node long, step long, state int")
    h, w = P.pseudolikelihood_step(panel, *exact4, rate=1.0)
    before = {x.node: x.h for x in exact4[0].collect()}
    assert max(abs(x.h - before[x.node]) for x in h.collect()) < 0.01
    assert w.count() == 6


def test_surrogate_keeps_the_spectrum(spark):
    panel = series(spark, [3, 1, 4, 1, 5, 9, 2, 6])
    a = {x.frequency: x.power for x in K.power_spectrum(panel).collect()}
    b = {x.frequency: x.power for x in K.power_spectrum(X.phase_surrogate(panel)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_power_law_exponent_is_recovered(spark):
    k = np.arange(1, 400)
    p = k**-2.3 / (k**-2.3).sum()
    counts = spark.createDataFrame([("a", int(v), int(n)) for v, n in zip(k, np.round(p * 1e6), strict=True) if n], "subject string, v long, n long")
    got = S.power_law_grid(counts, ["subject"], "v", "n", 1, [2.0, 2.1, 2.2, 2.3, 2.4, 2.5], 100).first()
    assert abs(got.exponent - 2.3) < 1e-9 and got.ks < 0.01


def test_empty_panel(spark):
    none = spark.createDataFrame([], "subject string, node long, step long, state int")
    assert M.functional_connectivity(none).count() == 0 and T.avalanches(none).count() == 0


def test_band_links_of_copies(spark):
    """Copies are one class and their links are counted, one row a row: 20,000 copies have 400 million pairs."""
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 40)) / 4, int(rng.integers(0, 6))) for i in range(400)]
    rows += [(400, None, 1.0, 1), (401, "a", None, 1), (402, "a", 1.0, None), (403, "a", 1.0, None)]
    got = {r.id: (r.class_id, r.n_links) for r in R.band_links(spark.createDataFrame(rows, "id long, key string, x double, y int"), ["key"], {"x": 0.5, "y": 1}).collect()}
    whole = lambda r: None not in r
    want = {a[0]: (min(b[0] for b in rows if a[1:] == b[1:]), sum(whole(a) and whole(b) and a[1] == b[1] and abs(a[2] - b[2]) <= 0.5 and abs(a[3] - b[3]) <= 1 for b in rows)) for a in rows}
    assert got == want
    many = spark.range(20_000).select("id", F.lit("a").alias("key"), F.lit(1.0).alias("x"))
    out = R.band_links(many, ["key"], {"x": 0.5})
    assert out.count() == 20_000 and out.agg(F.min("n_links"), F.max("n_links"), F.max("class_id")).first()[:] == (20_000, 20_000, 0)
