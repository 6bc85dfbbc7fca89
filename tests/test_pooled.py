"""Data-parallel pseudolikelihood fits against the whole series in one matrix, and fits of one group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import fitting as Fit
from lattica.operators import pooled as P
from lattica.operators import sampling as K

N = 5


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    base = rng.choice([-1, 1], (90, 1)) * rng.choice([-1, 1], (1, N), p=[0.3, 0.7])
    return {s: np.where(rng.random((90 - 10 * k, N)) < 0.2, -base[: 90 - 10 * k], base[: 90 - 10 * k]) for k, s in enumerate("abc")}


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(s, i, t, int(v)) for s, x in series.items() for t, own in enumerate(x) for i, v in enumerate(own)]
    rows += [("a", 0, 999, 1)]  # a step that lacks nodes
    return spark.createDataFrame(rows, "subject string, node long, step long, state int").cache()


def start(spark, *names):
    return spark.createDataFrame([(m, 1.0, [0.0] * N, [0.0] * N * N) for m in names], K.MODEL)


def plain(x, n_updates, rate, symmetric=True, adam=False):
    theta, opt = np.zeros(N + N * N), P.Adam(rate)
    for _ in range(n_updates):
        h, w = theta[:N], theta[N:].reshape(N, N)
        e = x - np.tanh(h + x @ w.T)
        g = e.T @ x
        g = g + g.T if symmetric else g
        np.fill_diagonal(g, 0)
        g = np.concatenate([e.sum(0), g.ravel()]) / len(x)
        theta = theta + (opt.step(g) if adam else rate * g)
    return theta


def theta(r):
    return np.array([*r.h, *r.w])


@pytest.mark.parametrize("optimizer", ["gradient", "adam"])
@pytest.mark.parametrize("symmetric", [True, False])
def test_pooled_equals_one_matrix(spark, panel, series, optimizer, symmetric):
    fitted, history = P.fit_pooled(start(spark, "group"), panel, 6, 0.1, optimizer=optimizer, symmetric=symmetric, block=16)
    want = plain(np.concatenate(list(series.values())).astype(float), 6, 0.1, symmetric, optimizer == "adam")
    assert np.abs(theta(fitted.first()) - want).max() < 1e-9
    h = history.orderBy("update").collect()
    assert [r.n_steps for r in h] == [240] * 6
    assert optimizer == "adam" or all(a.log_likelihood < b.log_likelihood for a, b in zip(h, h[1:], strict=False))


def test_pairs_of_models_and_subjects(spark, panel, series):
    """A group, replicas, one subject, a model without subjects, a subject without a model."""
    names = ("group", "a/0", "a/1", "nobody")
    pairs = spark.createDataFrame([("group", "a"), ("group", "b"), ("a/0", "a"), ("a/1", "a"), ("a/1", "a"), ("other", "c")], "model string, subject string")
    fitted, history = P.fit_pooled(start(spark, *names), panel, 4, 0.2, pairs, batch_bytes=2 * 8 * (N + N * N))
    got = {r.model: theta(r) for r in fitted.collect()}
    x = {s: v.astype(float) for s, v in series.items()}
    assert np.abs(got["group"] - plain(np.concatenate([x["a"], x["b"]]), 4, 0.2)).max() < 1e-9
    for m in ("a/0", "a/1"):
        assert np.abs(got[m] - plain(x["a"], 4, 0.2)).max() < 1e-9
    assert not got["nobody"].any() and history.where("model = 'nobody'").count() == 0
    alone = {r.model: theta(r) for r in Fit.fit_pseudolikelihood(start(spark, "a/0", "a/1"), panel.where("step < 900"), 4, 0.2).collect()}
    assert all(np.abs(alone[m] - got[m]).max() < 1e-9 for m in alone) and len(alone) == 2


def test_unmatched_names_and_replicas_in_one_group(spark, panel):
    """fitting._beside: more subjects than models, more models than subjects, and a column that names the subject."""
    whole = panel.where("step < 900")
    got = Fit.fit_pseudolikelihood(Fit.replicas(start(spark, "a", "b", "nobody"), 2), whole, 2, 0.1).collect()
    assert sorted(r.model for r in got) == ["a/0", "a/1", "b/0", "b/1"]
    named = start(spark, "x", "y").withColumn("subject", F.lit("c"))
    assert sorted(r.model for r in Fit.fit_pseudolikelihood(named, whole, 2, 0.1).collect()) == ["x", "y"]
    assert Fit.fit_windows(start(spark, "a"), whole, 10, 0.05).count() == 1


def test_parts_fields_and_tolerance(spark, panel, series):
    fitted, history = P.fit_pooled(start(spark, "g"), panel, 9, 0.05, parts=3, with_fields=False, block=8)
    r = fitted.first()
    assert not any(r.h) and any(r.w)
    seen = [x.n_steps for x in history.orderBy("update").collect()]
    assert all(sum(seen[k : k + 3]) == 240 for k in (0, 3, 6)) and max(seen) < 240
    _, history = P.fit_pooled(start(spark, "g"), panel, 500, 0.2, tolerance=0.02)
    assert 1 < history.count() < 500


def test_a_broken_run_goes_on(spark, panel, tmp_path):
    whole = P.fit_pooled(start(spark, "g"), panel, 8, 0.1, optimizer="adam", parts=2)[0].first()
    at = str(tmp_path / "fit")
    P.fit_pooled(start(spark, "g"), panel, 5, 0.1, optimizer="adam", parts=2, path=at, every=2)
    again, history = P.fit_pooled(start(spark, "g"), panel, 8, 0.1, optimizer="adam", parts=2, path=at, every=2)
    assert np.abs(theta(again.first()) - theta(whole)).max() < 1e-12
    assert history.agg(F.min("update")).first()[0] == 4


def test_empty(spark, panel):
    assert P.fit_pooled(start(spark, "g").limit(0), panel, 2, 0.1)[0].count() == 0
    assert not any(P.fit_pooled(start(spark, "g"), panel.limit(0), 2, 0.1)[0].first().h or [0])
