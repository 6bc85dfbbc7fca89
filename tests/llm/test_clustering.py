"""Centroids and distances against a plain search."""

from __future__ import annotations

import hashlib

import numpy as np

from lattica.llm import clustering as C
from lattica.llm.queries import op13_centroids


def plain(vectors: list[tuple], k=16, rounds=3):
    x = np.array([v for _, v in vectors], np.int64)
    key = [(hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None]
    c = np.array([v for _, v in sorted(key)[:k]], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = x[at == j].sum(0) // (at == j).sum()
    return at, d.min(1), c


def test_query(spark, smoke):
    rows = spark.read.parquet(f"{smoke}/embeddings.parquet").orderBy("vec_id").collect()
    own = [(r.vec_id, np.floor(64 * np.array(r.embedding, np.float64)).astype(int).tolist()) for r in rows]
    at, d, c = plain(own)
    got = {r.vec_id: r for r in op13_centroids(spark, smoke).collect()}
    assert len(got) == len(own)
    for (i, _), a, e in zip(own, at, d, strict=True):
        r = got[i]
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia) == (a, e, d[at == a].sum(), d.sum())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()


def test_edges(spark):
    """Null, short, odd and huge vectors are left out; ties, repeated rows and ids, rows without an id, extra columns."""
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    good = [(i % 25, rng.integers(-3, 3, 4).tolist()) for i in range(60)] + [(None, [1.0, 2, 3, 4]), (3, [0.5] * 4), (3, [0.5] * 4)]
    bad = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, nan, 1, 1]), (104, [1.0, inf, 1, 1]), (105, [1.0, None, 1, 1]), (106, [1e30, 1, 1, 1])]
    rows = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, q int, norms int")
    found, centroids = C.cluster(rows, k=16, dim=4, segment=3)
    at, d, c = plain([(i, [int(np.floor(64 * x)) for x in v]) for i, v in good])
    assert (centroids == c).all()
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted(zip([i for i, _ in good], at.tolist(), d.tolist(), strict=True), key=key)
    some, centroids = C.cluster(rows.where("vec_id < 2"), k=16, dim=4)
    assert some.count() == len([1 for i, _ in good if i is not None and i < 2]) and len(centroids) <= 16
    for empty in (rows.limit(0), rows.where("vec_id > 99")):
        assert C.with_inertia(*C.cluster(empty, dim=4)).collect() == []


def test_screening_measures_few_and_misses_none():
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (16, 64))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-40, 40, (5000, 64))
    at, d, measured = C.screened(x, C.segment_norms(x, 8), centres, 8)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    assert measured < 0.25 * every.size
    # bounds of equal vectors are not above the distance 0, and ties go to the smaller number
    twice = np.repeat(centres[:8], 2, axis=0)
    at, d, _ = C.screened(centres, C.segment_norms(centres, 8), twice, 8)
    assert (at[:8] == 2 * np.arange(8)).all() and not d[:8].any()
    big = rng.integers(-(1 << 27), 1 << 27, (200, 64))
    at, d, _ = C.screened(big, C.segment_norms(big, 8), big[:16], 8)
    assert (at[:16] == np.arange(16)).all() and not d[:16].any()
