"""Fits against exact enumeration on four nodes, searches, starts, edits and bursts."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import fitting as Fit
from lattica.operators import sampling as K
from lattica.operators import temporal as T

N = 4
H = np.array([0.3, -0.2, 0.1, 0.0])
W = np.array([[0, 0.4, -0.1, 0.2], [0.4, 0, 0.3, 0], [-0.1, 0.3, 0, -0.2], [0.2, 0, -0.2, 0]])
STATES = np.array(list(itertools.product([-1.0, 1.0], repeat=N)))


def exact(h, w, beta=1.0):
    p = np.exp(beta * (STATES @ h + 0.5 * np.einsum("ki,ij,kj->k", STATES, w, STATES)))
    return p / p.sum()


def moments(h, w, beta=1.0):
    p = exact(h, w, beta)
    return p @ STATES, np.einsum("k,ki,kj->ij", p, STATES, STATES)


def model_rows(*rows):
    return [(name, float(beta), [float(x) for x in h], [float(x) for x in np.asarray(w).ravel()]) for name, beta, h, w in rows]


def targets(spark, *rows):
    return spark.createDataFrame([(name, [float(x) for x in m], [float(x) for x in p.ravel()]) for name, (m, p) in rows], "model string, m array<double>, p array<double>")


@pytest.fixture(scope="module")
def zero(spark):
    return spark.createDataFrame(model_rows(("a", 1, H * 0, W * 0), ("b", 1, H * 0, W * 0)), K.MODEL)


@pytest.fixture(scope="module")
def want(spark):
    return targets(spark, ("a", moments(H, W)), ("b", moments(-H, W)))


@pytest.fixture(scope="module")
def panel(spark):
    """Every state of four nodes as often as the model of a (or b) says, of 4000 steps."""
    rows, step = [], 0
    for name, h in (("a", H), ("b", -H)):
        x = np.repeat(STATES, np.round(4000 * exact(h, W)).astype(int), axis=0)
        np.random.default_rng(1).shuffle(x)
        rows += [(name, i, t, int(s)) for t, own in enumerate(x) for i, s in enumerate(own)]
    return spark.createDataFrame(rows, "subject string, node long, step long, state int").cache()


def fields(df, name="a"):
    x = df.where(F.col("model") == name).first()
    return np.array(x.h), np.array(x.w).reshape(N, N)


def test_simulation_meets_exact_moments_in_every_schedule(spark):
    models = spark.createDataFrame(model_rows(("a", 1, H, W)), K.MODEL)
    m, p = moments(H, W)
    for schedule, n in (("sweep", 6000), ("random_node", 24000)):
        x = Fit.goodness(models, targets(spark, ("a", (m, p))), [n], schedule).first()
        assert x.mean_rmse < 0.05 and x.product_rmse < 0.05 and x.cov_rmse < 0.05 and x.fc_corr > 0.95 and 0 < x.flip_rate < 1


def test_synchronous_steps_of_unbound_nodes(spark):
    """Without couplings all nodes at once are as good as one by one: a flip from s has the chance min(1, exp(-2 h s))."""
    models = spark.createDataFrame(model_rows(("a", 1, H, W * 0)), K.MODEL)
    x = Fit.goodness(models, targets(spark, ("a", moments(H, W * 0))), [20000], "synchronous").first()
    assert x.mean_rmse < 0.03 and x.product_rmse < 0.03


@pytest.mark.parametrize("how", [{}, {"rule": "power", "rate": 0.02}, {"rule": "cubic", "rate": 2.0}, {"rule": "log", "rate": 0.02}, {"schedule": "random_node", "steps": 800}])
def test_boltzmann_learning_lowers_the_error(spark, zero, want, how):
    how = dict(how)
    rate, steps = how.pop("rate", 0.1), how.pop("steps", 200)
    fitted = K.fit_by_simulation(zero, want, 60, steps, rate, **how)
    before = {x.model: x.product_rmse for x in Fit.goodness(zero, want, [4000]).collect()}
    after = {x.model: x.product_rmse for x in Fit.goodness(fitted, want, [4000]).collect()}
    assert all(after[k] < 0.6 * before[k] for k in before)


def test_own_rates_and_no_fields(spark, zero, want):
    rates = zero.withColumn("rate", F.when(F.col("model") == "a", 0.1).otherwise(0.0))
    fitted = K.fit_by_simulation(rates, want, 30, 100)
    assert np.abs(fields(fitted)[0]).max() > 0.05 and np.abs(fields(fitted, "b")[1]).max() == 0
    alone = K.fit_by_simulation(zero, want, 20, 100, 0.1, with_fields=False)
    assert np.abs(fields(alone)[0]).max() == 0 and np.abs(fields(alone)[1]).max() > 0.05


def test_saving_and_resuming(spark, zero, want, tmp_path):
    path = str(tmp_path / "fit")
    first = Fit.fit_and_save(zero, want, path, 2, 5, 50, 0.1)
    assert {x.updates for x in spark.read.parquet(path).select("updates").distinct().collect()} == {5, 10}
    again = Fit.fit_and_save(zero, want, path, 3, 5, 50, 0.1)
    whole = Fit.fit_and_save(zero, want, str(tmp_path / "other"), 3, 5, 50, 0.1)
    assert sorted(again.collect()) == sorted(whole.collect()) and first.count() == 2


@pytest.mark.parametrize("how", [{}, {"block": 700}, {"optimizer": "adam", "rate": 0.02, "n": 400}, {"optimizer": "sgd", "block": 500, "rate": 0.2, "n": 120}, {"symmetric": False}])
def test_pseudolikelihood_finds_the_model(spark, zero, panel, how):
    how = dict(how)
    fitted = Fit.fit_pseudolikelihood(zero, panel, how.pop("n", 200), how.pop("rate", 0.3), **how)
    h, w = fields(fitted)
    assert np.abs(h - H).max() < 0.06 and np.abs(w - W).max() < 0.06
    assert np.abs(fields(fitted, "b")[0] + H).max() < 0.06


def test_windows_and_transitions(spark, zero, panel):
    for how in ("fixed", "sliding", "random"):
        h, _ = fields(Fit.fit_windows(zero, panel.where("step < 1500"), 50, 0.05, how, n_epochs=3, every=50))
        assert np.sign(h[:2]).tolist() == [1, -1]
    flips = np.minimum(1, np.exp(-2 * STATES * (H + STATES @ W))) / N
    rows = [("a", [int(v) for v in s], 100000, [int(round(100000 * f)) for f in own]) for s, own in zip(STATES, flips, strict=True)]
    fitted = Fit.fit_transitions(spark.createDataFrame(rows, "model string, state array<int>, n long, flips array<long>"), 800, 0.02)
    h, w = fields(fitted)
    assert np.abs(h - H).max() < 0.02 and np.abs(w - W).max() < 0.02


@pytest.mark.parametrize("measure", ["product_rmse", "cov_rmse", "flip_distance", "fc_rmse"])
def test_each_model_gets_its_own_beta(spark, measure):
    """Targets come from the same couplings at 0.4 and at 1.5, the second above the first interval."""
    models = spark.createDataFrame(model_rows(("a", 1, H, W), ("b", 1, H, W)), K.MODEL)
    want = targets(spark, ("a", moments(H, W, 0.4)), ("b", moments(H, W, 1.5)))
    rates = K.simulated_means(spark.createDataFrame(model_rows(("a", 0.4, H, W), ("b", 1.5, H, W)), K.MODEL), 4000).where("i = j").groupBy("model").agg(F.avg("flip_rate").alias("flip_rate"))
    found = Fit.search_beta(models, want.join(rates, "model"), measure, 4, 6, 1500)
    best = {x.model: x.beta for x in Fit.at_best_beta(models, found, Fit.MEASURES[measure]).collect()}
    assert found.count() == 8 and abs(best["a"] - 0.4) < 0.15 and abs(best["b"] - 1.5) < 0.35


def test_doubling_and_largest_measures(spark):
    models = spark.createDataFrame(model_rows(("a", 1, H * 0.4, W * 0.4)), K.MODEL)
    want = targets(spark, ("a", moments(H, W)))
    found = {x["round"]: x for x in Fit.search_beta(models, want, "product_rmse", 4, 5, 1500, doubling=True).collect()}
    assert found[0].beta == found[0].low == 1.0 and found[0].high == 2.0 and abs(found[3].beta - 2.5) < 0.6
    assert Fit.search_beta(models, want, "fc_corr", 1, 4, 2000, high=20.0).first().beta > 1e-8


def test_starts(spark, want):
    m, p = moments(H, W)
    got = {how: fields(Fit.initial(want, how)) for how in ("zero", "means", "centred", "inverse_cov", "log_means", "uniform", "normal")}
    for h, w in got.values():
        assert np.allclose(w, w.T) and np.all(np.diag(w) == 0)
    assert np.allclose(got["means"][0], m) and got["zero"][0].sum() == 0
    off = ~np.eye(N, dtype=bool)
    assert np.allclose(got["centred"][1][off], (p - np.outer(m, m))[off])
    assert np.allclose(got["inverse_cov"][1][off], -np.linalg.inv(p - np.outer(m, m))[off])
    assert 0 <= got["uniform"][0].min() and got["uniform"][0].max() <= 1
    assert sorted(Fit.initial(want, "normal").collect()) == sorted(Fit.initial(want.repartition(3), "normal").collect())


def test_edits_replicas_and_best_of_groups(spark, want):
    models = spark.createDataFrame(model_rows(("a", 1, H, W), ("b", 1, -H, W)), K.MODEL)
    assert np.allclose(fields(Fit.overridden(models, "mean_h"))[0], H.mean())
    assert np.allclose(fields(Fit.overridden(models, "area_h", [0, 0, 1, 1]))[0], [0.05, 0.05, 0.05, 0.05])
    assert not fields(Fit.overridden(models, "zero_w"))[1].any() and not fields(Fit.overridden(models, "zero_h"))[0].any()
    many = Fit.replicas(models, 3)
    wrong = Fit.overridden(many.where("model not like '%/1'"), "zero_w").unionByName(many.where("model like '%/1'"))
    per = want.withColumn("model", F.explode(F.transform(F.array(F.lit("0"), F.lit("1"), F.lit("2")), lambda i: F.concat_ws("/", "model", i))))
    reports = Fit.goodness(wrong, per, [3000])
    best = Fit.best_models(wrong, reports, "product_rmse")
    assert {x.replica for x in best.collect()} == {"a/1", "b/1"}
    members = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b")], "model string, group string")
    own = {x.model: x.h for x in Fit.individual(best, members).collect()}
    assert np.allclose(own["s2"], H) and np.allclose(own["s3"], -H)


def test_folds(spark):
    panel = spark.createDataFrame([("a", i, 0, 1) for i in range(10)], "subject string, node long, step long, state int")
    got = sorted((x.subject, x.node) for x in Fit.folded(panel, 4).collect())
    assert got == [(f"a/{b}", i) for b in range(2) for i in range(4)]


def test_running_bursts_are_those_of_the_kept_series(spark):
    models = spark.createDataFrame(model_rows(("a", 1, H, W), ("b", 0.5, H, W)), K.MODEL)
    got = {(x.model, x.measure, x.value): x.n for x in Fit.running_bursts(models, 400).collect()}
    series = K.simulated_series(models, 400).drop("beta")
    runs = T.runs(T.activations(series), censored=True).where("active").collect()
    want = {}
    for x in runs:
        for measure, value in (("duration", x.duration), ("size", x["size"])):
            want[x.subject, measure, value] = want.get((x.subject, measure, value), 0) + 1
    assert {k: v for k, v in got.items() if k[1] != "nodes"} == want
    assert sum(v for k, v in got.items() if k[1] == "nodes") == len(runs)


def test_connectivity_of_simulated_means(spark):
    models = spark.createDataFrame(model_rows(("a", 1, H, W)), K.MODEL)
    m, p = moments(H, W)
    for x in Fit.simulated_connectivity(K.simulated_means(models, 8000)).collect():
        assert abs(x.cov - (p - np.outer(m, m))[x.i, x.j]) < 0.05 and abs(x.fc) <= 1 and 0 < x.flip_i < 1


def test_convergence_by_length(spark):
    models = spark.createDataFrame(model_rows(("a", 1, H, W)), K.MODEL)
    got = {x.n_steps: x.product_rmse for x in Fit.goodness(models, targets(spark, ("a", moments(H, W))), [20, 200, 8000]).collect()}
    assert set(got) == {20, 200, 8000} and got[8000] < got[20]


def test_transition_table(spark):
    x = np.random.default_rng(4).choice([-1, 1], (200, 3))
    panel = spark.createDataFrame([("a", i, t, int(x[t, i])) for t in range(200) for i in range(3)], "subject string, node long, step long, state int")
    want: dict = {}
    for t in range(199):
        n, f = want.setdefault(tuple(x[t].tolist()), [0, np.zeros(3, int)])
        want[tuple(x[t].tolist())] = [n + 1, f + (x[t] != x[t + 1])]
    got = {tuple(r.state): [r.n, list(r.flips)] for r in Fit.transition_table(panel).collect()}
    assert got == {k: [n, f.tolist()] for k, (n, f) in want.items()}
