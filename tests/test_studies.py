"""Linear models, power laws, filters, merges, projections and nulls against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import blocked
from lattica.operators import cluster as C
from lattica.operators import inference as I
from lattica.operators import moments as M
from lattica.operators import relate as R
from lattica.operators import sampling as K
from lattica.operators import spectra as X


def long_panel(spark, x, subject="a", kind="double", name="value"):
    return spark.createDataFrame([(subject, i, t, x[t, i].item()) for t in range(x.shape[0]) for i in range(x.shape[1])], f"subject string, node long, step long, {name} {kind}")


def test_blocked_sums_in_tiles_and_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, (1500, 7))
    panel = long_panel(spark, x, kind="long").where("not (node = 3 and step % 2 = 0)")
    for tile in (3, 1024):
        for r in blocked.pair_sums(panel, "value", ["subject"], diagonal=True, tile=tile).collect():
            at = np.arange(1500) % 2 == 1 if 3 in (r.i, r.j) else np.ones(1500, bool)
            a, b = x[at, r.i].astype(float), x[at, r.j].astype(float)
            assert (r.n, r.sx, r.sy, r.sxy, r.sxx, r.syy) == (len(a), a.sum(), b.sum(), a @ b, a @ a, b @ b)


def test_many_nodes_have_their_own_observables(spark):
    panel = spark.createDataFrame([("a", n, t, 1 if (n + t) % 3 else -1) for n in (0, 1, 1000, 1001) for t in range(9)], "subject string, node long, step long, state int")
    assert M.fisher_diagonal(panel).count() == 10 and M.fisher_information(panel).count() == 55
    one = {(r.a, r.b): r.information for r in M.fisher_information(panel).collect()}
    for r in M.fisher_diagonal(panel).collect():
        assert abs(one[r.a, r.a] - r.information) < 1e-12


def test_connectivity_of_a_whole_brain(spark):
    """360 nodes over 1,200 steps."""
    panel = spark.range(360 * 1200).select(F.lit("a").alias("subject"), (F.col("id") % 360).alias("node"), F.floor(F.col("id") / 360).alias("step"), F.when(F.rand(3) > 0.5, 1).otherwise(-1).alias("state"))
    got = M.functional_connectivity(panel).agg(F.count("*").alias("n"), F.max(F.abs("fc")).alias("m")).first()
    assert got.n == 360 * 359 // 2 and got.m < 0.25


def test_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.normal(size=200)
    rows = [(i % 2, *x[i].tolist(), y[i].item()) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, y double")
    for r in I.least_squares_many(df, ["g"], ["a", "b", "c", "d"], "y").collect():
        own = np.arange(200) % 2 == r.g
        want, *_ = np.linalg.lstsq(np.column_stack([x[own], np.ones(own.sum())]), y[own], rcond=None)
        assert np.allclose([r.b_a, r.b_b, r.b_c, r.b_d, r.intercept], want) and r.r2 > 0.99
    same = I.least_squares_many(df.withColumn("e", F.col("a") * 2), ["g"], ["a", "e"], "y").first()
    assert same.b_e is None
    fits = I.least_squares_many(df, ["g"], ["a", "b", "c", "d"], "y")
    assert all(q.corr > 0.99 and q.rmse < 0.2 for q in I.fit_quality(I.predicted(df, fits, ["g"], ["a", "b", "c", "d"]), ["g"], "y").collect())


def test_splits_and_moved_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(v), float(2 * v + 0.1 * rng.normal())) for i, v in enumerate(x)], "k long, x double, y double")
    own = I.split_fits(df, "k", [], ["x"], "y", 5).collect()
    moved = I.split_fits(df, "k", [], ["x"], "y", 5, null=True).collect()
    assert len(own) == len(moved) == 5 and all(r.corr > 0.99 for r in own) and all(abs(r.corr) < 0.3 for r in moved)


def test_permutations_move_every_key_once(spark):
    ids = spark.range(500).withColumnRenamed("id", "k")
    rows = R.permuted(ids, "k", 3).collect()
    for p in range(3):
        own = [r for r in rows if r.perm == p]
        assert sorted(r.k for r in own) == sorted(r.partner for r in own) == list(range(500))
        assert sum(r.k == r.partner for r in own) < 20
    assert sorted(rows) == sorted(R.permuted(ids.repartition(7), "k", 3).collect())


def test_group_coefficients(spark):
    """Subjects that follow the group's line are told exactly, up to their own noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 40))
    rows = [(s, n, float(x[s, n]), float(3 * x[s, n] + 1)) for s in range(6) for n in range(40)]
    got = I.group_coefficients_on_individuals(spark.createDataFrame(rows, "subject long, node long, x double, y double"), "subject", "node", ["x"], "y").collect()
    assert len(got) == 240 and all(abs(r.y - r.prediction) < 1e-9 for r in got)


def test_null_and_critical_value(spark):
    seen = spark.createDataFrame([("a", 0.5)], "k string, corr double")
    null = spark.createDataFrame([("a", i, (-1) ** i * i / 100) for i in range(100)], "k string, perm long, corr double")
    r = I.against_null(seen, null, ["k"], 0.05, 1, 100).first()
    assert r.p == 0.5 and r.critical == 0.95 and r.p_corrected == 0.5


def test_zeta_on_intervals(spark):
    rows = [(a, f, l) for a in (-2.0, 0.0, 1.0, 1.5, 3.0) for f, l in ((1, 5), (3, 500), (1, 70), (10, 4000))]
    df = spark.createDataFrame(rows, "a double, f long, l long").select("*", F.exp(I.log_zeta_between(F.col("a"), F.col("f"), F.col("l"))).alias("z"))
    for r in df.collect():
        want = (np.arange(r.f, r.l + 1, dtype=float) ** -r.a).sum()
        assert abs(r.z / want - 1) < 1e-7


def test_power_laws_are_recovered(spark):
    ks = np.arange(1, 4000)
    rows = [(name, int(k), int(round(1e7 * k**-a / (ks**-a).sum()))) for name, a in (("x", 1.8), ("y", 3.1)) for k in ks]
    counts = spark.createDataFrame([r for r in rows if r[2]], "key string, v long, n long")
    sums = counts.groupBy("key").agg(F.lit(1).cast("long").alias("first"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.log("v")).alias("logs"))
    got = {r.key: r.exponent for r in I.power_law_refined(sums, ["key"], 8, 9).collect()}
    assert abs(got["y"] - 3.1) < 0.01 and abs(got["x"] - 1.8) < 0.03
    few = counts.where("v <= 12")
    fits = I.power_law_refined(I.interval_sums(few, ["key"], "v", "n", 4, 5), ["key"], 9, 9, low=-5.0)
    out = I.interval_distance(fits, few, ["key"], "v", "n").collect()
    assert len(out) == 2 * sum(12 - f - 3 for f in range(1, 9)) and all(abs(r.exponent - {"x": 1.8, "y": 3.1}[r.key]) < 0.02 and r.ks < 1e-3 for r in out)


def test_the_bracket_grows(spark):
    sums = spark.createDataFrame([("a", 1, 1e6, float(1e6 * np.log(2) / 20000))], "key string, first long, n double, logs double")
    assert I.power_law_refined(sums, ["key"], 10, 9).first().exponent > 10


def test_chebyshev_response(spark):
    """Down by 40 dB at the edges and outside of them, by little in the middle; and zero phase."""
    zeros, poles, gain = X.chebyshev_two(5, 40, 0.01, 0.1, 1 / 0.72)
    assert len(zeros) == len(poles) == 10 and np.abs(poles).max() < 1

    def response(f):
        z = np.exp(2j * np.pi * np.asarray(f) * 0.72)
        return np.abs(gain * np.prod(z[:, None] - zeros, axis=1) / np.prod(z[:, None] - poles, axis=1))

    assert np.allclose(response([0.01, 0.1]), 0.01, atol=1e-6)
    assert response(np.linspace(0.0001, 0.0099, 50)).max() <= 0.0101 and response(np.linspace(0.1001, 0.69, 200)).max() <= 0.0101
    assert abs(response([np.sqrt(0.001)])[0] - 1) < 1e-3
    t = np.arange(1500)
    inside, outside = np.sin(2 * np.pi * 0.03 * 0.72 * t), np.sin(2 * np.pi * 0.25 * 0.72 * t)
    got = X.band_pass(long_panel(spark, np.column_stack([inside, outside, inside + outside])), 0.01, 0.1, 0.72).toPandas()
    y = got.pivot(index="step", columns="node", values="value").to_numpy()[300:1200]
    assert np.abs(y[:, 0] - inside[300:1200]).max() < 0.02 and np.abs(y[:, 1]).max() < 0.01 and np.abs(y[:, 2] - inside[300:1200]).max() < 0.02


def test_surrogates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=256).cumsum()
    x = np.column_stack([base + 0.1 * rng.normal(size=256), base + 0.1 * rng.normal(size=256)])
    panel = long_panel(spark, x)
    square = lambda df: df.toPandas().pivot(index="step", columns="node", values="value").sort_index().to_numpy()
    assert np.abs(square(X.phase_surrogate(panel, shuffle=False)) - x).max() < 1e-9
    for shared in (False, True):
        y = square(X.phase_surrogate(panel, shared=shared))
        assert np.allclose(np.abs(np.fft.rfft(y, axis=0)), np.abs(np.fft.rfft(x, axis=0))) and np.abs(y - x).max() > 1
        assert (np.corrcoef(y.T)[0, 1] > 0.95) == shared


def test_merged_tree(spark):
    rng = np.random.default_rng(6)
    x = rng.choice([-1, 1], (300, 6))
    x[:, 4] = x[:, 1]
    tree = sorted(C.merged_tree(long_panel(spark, x, kind="long", name="state")).collect(), key=lambda r: r.parent)
    series, alive = {i: x[:, i].astype(float) for i in range(6)}, list(range(6))
    for r in tree:
        best = max(((float(((series[a] + series[b]) ** 2).sum()), -i, -j) for i, a in enumerate(alive) for j, b in enumerate(alive) if i < j))
        a, b = alive[-best[1]], alive[-best[2]]
        assert (r.left, r.right, r.height) == (a, b, best[0])
        series[r.parent] = series[a] + series[b]
        alive = [k for k in alive if k not in (a, b)] + [r.parent]
    assert (tree[0].left, tree[0].right) == (1, 4) and len(tree) == 5
    frame = C.merged_tree(long_panel(spark, x, kind="long", name="state"))
    assert sorted(r.node for r in C.leaves_of(frame, tree[-1].parent, "a").collect()) == list(range(6))


def test_components_projections_and_cosines(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5)) @ np.diag([5, 3, 1, 0.1, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    cov = np.cov(x.T, bias=True)
    square = spark.createDataFrame([("a", i, j, float(cov[i, j])) for i in range(5) for j in range(5)], "subject string, i long, j long, cov double")
    found = K.eigen(square, "cov")
    vectors = found.select("subject", "component", F.posexplode("vector").alias("node", "v"))
    for r in found.collect():  # residuals
        assert np.allclose(cov @ np.array(r.vector), r.eigenvalue * np.array(r.vector))
    rows = long_panel(spark, x - x.mean(axis=0))
    coordinates = I.projected(rows, vectors, ["subject"])
    var = {r.component: r.v for r in coordinates.groupBy("component").agg(F.var_pop("coordinate").alias("v")).collect()}
    assert np.allclose([var[k] for k in range(5)], sorted(np.linalg.eigvalsh(cov))[::-1])
    back = I.rebuilt(coordinates, vectors, ["subject"], ["step"]).toPandas().pivot(index="step", columns="node", values="value").to_numpy()
    assert np.allclose(back, x - x.mean(axis=0))
    less = I.rebuilt(coordinates, vectors, ["subject"], ["step"], without=0).agg(F.var_pop("value")).first()[0]
    assert less < np.var(back)
    errors = sorted(I.reconstruction(found, ["subject"], 0.05).collect(), key=lambda r: r.n_components)
    assert abs(errors[-1].rmse) < 1e-6 and abs(errors[-1].explained - 1) < 1e-9 and sum(r.stable for r in errors) == 1
    u, s, vt = np.linalg.svd(x - x.mean(axis=0))
    two = (u[:, :2] * s[:2]) @ vt[:2]
    assert abs(errors[1].rmse - np.sqrt(np.mean((x - x.mean(axis=0) - two) ** 2))) < 1e-9
    cos = {(r.component, r.other): r.cosine for r in I.cosines(vectors, vectors).collect()}
    assert all(abs(cos[a, b] - (a == b)) < 1e-9 for a in range(5) for b in range(5))


def test_inverse(spark):
    cov = np.cov(np.random.default_rng(8).normal(size=(50, 4)).T)
    square = spark.createDataFrame([("a", i, j, float(cov[i, j])) for i in range(4) for j in range(4)], "subject string, i long, j long, cov double")
    got = K.inverse(square, "cov").toPandas().pivot(index="i", columns="j", values="precision").to_numpy()
    assert np.allclose(got @ cov, np.eye(4))


def test_sandwich(spark):
    rng = np.random.default_rng(9)
    j, m = rng.normal(size=(3, 5)), rng.normal(size=(5, 5))
    df = lambda x, a, b: spark.createDataFrame([(p, q, float(x[p, q])) for p in range(x.shape[0]) for q in range(x.shape[1])], f"{a} long, {b} long, x double")
    got = I.sandwiched(df(j, "f", "k"), df(m, "k", "l")).toPandas().pivot(index="f", columns="g", values="x").to_numpy()
    assert np.allclose(got, j @ m @ j.T)


def test_distance_from_criticality(spark):
    rows = spark.createDataFrame([(2.0, 1.5, 1.9), (2.0, 1.0, 1.0)], "d double, s double, g double")
    got = [r.distance for r in I.criticality_distance(rows, "d", "s", "g").collect()]
    assert abs(got[0] - 0.1) < 1e-12 and got[1] is None


@pytest.mark.parametrize("name", ["split_fits", "group_on_individuals", "principal_components", "reconstruction", "clustered_series", "powerlaw_refined", "powerlaw_intervals", "criticality", "band_pass"])
def test_registered_queries_run(spark, smoke, name):
    from lattica import plans

    rows = plans.queries()[name](spark, smoke).collect()
    assert rows
