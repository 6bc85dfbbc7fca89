"""Leading eigenpairs against dense ones, at 16 nodes, of embeddings, and at 360 nodes by their residuals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import pooled
from lattica.operators import subspace as S
from lattica.plans.panel import states_of


@pytest.fixture(scope="module")
def blocks(spark, smoke):
    return pooled.step_blocks(states_of(spark, smoke))


def dense(x):
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    return values[::-1], vectors[:, ::-1]


def test_fisher_information(spark, blocks):
    rows, nodes = blocks
    i, j, _ = S.observables(len(nodes))
    one = rows.select("subject").first().subject
    own = rows.where(F.col("subject") == one)
    x = np.concatenate([np.frombuffer(bytes(r.x), np.int8).reshape(-1, len(nodes)) for r in own.collect()]).astype(float)
    values, vectors = dense(x[:, i] * np.where(i == j, 1, x[:, j]))
    for tile in (4096, 50):
        found = S.fisher_leading(own, len(nodes), 10, tile=tile, tolerance=1e-10)
        assert np.allclose(found.values, values[:10], rtol=1e-8) and found.n_rows == len(x)
        assert np.allclose(np.abs((found.vectors * vectors[:, :10]).sum(axis=0)), 1, atol=1e-6)
        assert abs(found.trace - values.sum()) < 1e-8 * values.sum()


def test_embeddings_until_stable(spark, smoke):
    """As many components, and the same errors, as the whole covariance gives."""
    rows = spark.read.parquet(f"{smoke}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = np.array([r.v for r in rows.collect()])
    values, vectors = dense(x)
    found, table = S.until_stable(rows.select("v"), S.vectors_in("v"), 64, 0.008, start=4)
    rmse = np.sqrt(np.maximum(values.sum() - np.cumsum(values), 0) / 64)
    first = int(np.flatnonzero(rmse - np.append(rmse[1:], 0) < 0.008 * np.sqrt(values.sum() / 64))[0]) + 1
    assert [n for n, *_, stable in table if stable] == [first]
    assert np.allclose([t[2] for t in table], rmse[: len(table)], atol=1e-7)
    got = {r.vec_id: r for r in S.coordinates(rows, "v", found, ["vec_id"], without=(0,)).collect()}
    one = rows.first()
    c = (np.array(one.v) - x.mean(0)) @ found.vectors
    assert np.allclose(got[one.vec_id].coordinates, c) and np.allclose(got[one.vec_id].rebuilt, x.mean(0) + found.vectors[:, 1:] @ c[1:])


def test_wide_observables(spark):
    """360 nodes, 64,980 observables: no square matrix anywhere; the pairs' residuals are small and the planted direction leads."""
    rng = np.random.default_rng(8)
    common = rng.choice([-1, 1], 400)
    x = np.where(rng.random((400, 360)) < 0.75, common[:, None], rng.choice([-1, 1], (400, 360))).astype(np.int8)
    rows = spark.createDataFrame([(x[a : a + 50].tobytes(),) for a in range(0, 400, 50)], "x binary").repartition(4)
    found = S.fisher_leading(rows, 360, 3, tolerance=1e-5, most_passes=40)
    assert found.residuals.max() <= 1e-5 * found.values[0] and found.passes < 40
    i, j, expand = S.observables(360)
    v = found.vectors[:, 0]
    assert len(np.unique(np.sign(v[i == j]))) == 1
    o = expand(x.astype(float), np.arange(len(i))) - found.mean
    assert np.linalg.norm(o.T @ (o @ v) / 400 - found.values[0] * v) <= 1e-4 * found.values[0]


def test_edges(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 3.0],)], "v array<double>")
    found = S.leading(rows, S.vectors_in("v"), 3, 5)
    assert found.trace == 0 and not found.values.any()
    assert S.leading(rows.limit(0), S.vectors_in("v"), 3, 2).n_rows == 0
    two = spark.createDataFrame([([0.0, 1.0],), ([2.0, 1.0],), ([4.0, 1.0],)], "v array<double>")
    found, table = S.until_stable(two, S.vectors_in("v"), 2, 0.01)
    assert np.allclose(found.values, [8 / 3, 0]) and [r[3] for r in table] == [True, False]
